"""Readers of papers, samples, records, artifacts and indices. Schemas are explicit; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions import dates as D
from skein.functions import text as X

Z = T.StructType([T.StructField(n, T.StringType()) for n in ("base_direction", "operator", "gap")])
SAMPLE = T.StructType([
    *(T.StructField(n, T.StringType()) for n in ("topic_id", "episode_id", "cutoff_date", "future_paper_id", "future_paper_title", "future_paper_published_date")),
    T.StructField("innovation", Z), T.StructField("context_paper_count", T.IntegerType()),
])
DZ_ROW = T.StructType([
    *(T.StructField(n, T.StringType()) for n in ("cutoff_t", "topic_id", "episode_id")), T.StructField("target_z", Z),
    *(T.StructField(n, T.StringType()) for n in ("operator_closed", "source_future_id", "future_paper_published_date")),
    T.StructField("context_paper_ids", T.ArrayType(T.StringType())), T.StructField("memory_text", T.StringType()), T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
])
WINDOW = T.StructType([
    T.StructField("cutoff_date", T.StringType()), T.StructField("train_count", T.LongType()), T.StructField("future_count", T.LongType()),
    T.StructField("evaluation", T.MapType(T.StringType(), T.DoubleType())),
])
ARTIFACT = T.StructType([
    *(T.StructField(n, T.StringType()) for n in ("strategy", "model_name", "mode")),
    T.StructField("topic_results", T.MapType(T.StringType(), T.StructType([T.StructField("topic_name", T.StringType()), T.StructField("windows", T.ArrayType(WINDOW))]))),
])
RECORD = T.StructType([
    *(T.StructField(n, T.StringType()) for n in ("id", "name", "strategy_name", "created_at")), T.StructField("leaderboard_score", T.DoubleType()),
    T.StructField("topic_runs", T.ArrayType(T.StructType([T.StructField("topic_id", T.StringType()), T.StructField("status", T.StringType()), T.StructField("error", T.StringType())]))),
])


def markdown_files(spark: SparkSession, root: str) -> DataFrame:
    """Columns path, text: every .md file below the folder but readme.md. Unreadable files are skipped."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").option("ignoreCorruptFiles", True).text(root, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).filter(F.lower(F.element_at(F.split("path", "/"), -1)) != "readme.md")


def markdown_pages(spark: SparkSession, root: str) -> DataFrame:
    """Columns path, text of papers that lie many to a file, parted by form feeds; the path ends in the folder's month and the paper's own id."""
    pages = spark.read.option("lineSep", "\f").option("recursiveFileLookup", True).text(root)
    month = F.regexp_extract(F.col("_metadata.file_path"), r"month=(\d{4}-\d{2})/", 1)
    return pages.select(F.concat(month, F.lit("/page.md")).alias("path"), F.col("value").alias("text"))


def parse_papers(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Papers of Markdown files: title, preamble, date, month, summary, keywords and references.

    A blank text, or one whose month neither preamble, id nor folder tells, gives no row. The date is the preamble's, else the end of the
    month in the id's first digits, else of the folder's.
    """
    raw = F.regexp_replace(F.col(text), "\r\n?", "\n")
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.md$", "")
    meta = files.filter(F.col(text).rlike(r"\S")).select(F.col(path).alias("source_path"), raw.alias("t"), stem.alias("stem"), X.preamble(raw).alias("metadata"))
    title = F.coalesce(X.h1_title(F.col("t")), F.col("stem"))
    paper_id = F.coalesce(F.col("metadata")["paper_id"], F.col("stem"))
    folder = F.regexp_extract("source_path", r"(\d{4}-\d{2})/[^/]*$", 1)
    given = F.coalesce(F.col("metadata")["date"], F.col("metadata")["published"])
    published = D.published_of_paper(given, paper_id, folder)
    listed = F.when(F.col("metadata")["keywords"].isNotNull(), F.split(F.col("metadata")["keywords"], r"\s*,\s*"))
    out = meta.select(
        paper_id.alias("paper_id"), title.alias("title"), F.date_format(published, "yyyy-MM").alias("month"), X.summary(F.col("t")).alias("summary"), X.keyword_list(listed, title).alias("keywords"),
        "source_path", published.alias("published"), "metadata", X.bibliography(F.col("t")).alias("refs"),
    )
    return out.filter("published is not null")


def corpus(spark: SparkSession, path: str, first: str, last: str) -> DataFrame:
    """A corpus table partitioned by month, months first to last, in the order of publication; other months' folders are not read."""
    return spark.read.parquet(path).filter(F.col("month").between(first, last)).orderBy("published", "paper_id")


def monthly_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Columns path, text of Parquet files of arxiv_id and text, one a month, they or their folders named by month: what ``parse_papers`` takes."""
    month = F.regexp_extract(F.col("_metadata.file_path"), r"(\d{4}-\d{2})[^/]*(?:/[^/]*)?\.parquet$", 1)
    return spark.read.schema("arxiv_id string, text string").parquet(path).select(F.concat(month, F.lit("/"), "arxiv_id", F.lit(".md")).alias("path"), "text")


def atom_entries(feed: Column) -> Column:
    """The entries of an Atom feed with id, title and published: struct of id, title, summary, published, updated, keywords (sorted categories)."""
    blocks = F.regexp_extract_all(feed, F.lit(r"(?s)<entry\b[^>]*>(.*?)</entry>"), F.lit(1))

    def tag(e: Column, name: str) -> Column:
        return F.trim(F.regexp_replace(F.regexp_extract(e, rf"(?s)<{name}\b[^>]*>(.*?)</{name}>", 1), r"\s+", " "))

    def entry(e: Column) -> Column:
        terms = F.sort_array(F.array_distinct(F.regexp_extract_all(e, F.lit(r'<category\b[^>]*\bterm="([^"]*)"'), F.lit(1))))
        return F.struct(F.regexp_extract(tag(e, "id"), r"([^/]+?)(?:v\d+)?$", 1).alias("id"), *(tag(e, n).alias(n) for n in ("title", "summary", "published", "updated")), terms.alias("keywords"))

    return F.filter(F.transform(blocks, entry), lambda e: (e["id"] != "") & (e["title"] != "") & (e["published"] != ""))


def atom_table(spark: SparkSession, path: str) -> DataFrame:
    """Atom feed files by Spark's own XML reader, one row per entry."""
    schema = "id string, title string, summary string, published string, updated string, category array<struct<_term:string>>"
    rows = spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path)
    keep = (F.coalesce("id", F.lit("")) != "") & (F.coalesce("title", F.lit("")) != "") & (F.coalesce("published", F.lit("")) != "")
    return rows.filter(keep).withColumn("keywords", F.sort_array(F.array_distinct("category._term"))).drop("category")


def json_lines(spark: SparkSession, path: str, schema: T.StructType, strict: bool = False) -> DataFrame:
    """Lines of JSON; malformed ones are dropped, or fail the read if ``strict``."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def hindsight_samples(spark: SparkSession, path: str, last_cutoff: str = "2024-03-31") -> DataFrame:
    """Samples with a cutoff of at most ``last_cutoff``, by cutoff month, date of publication and paper."""
    rows = json_lines(spark, path, SAMPLE).filter(D.cutoff_date(F.col("cutoff_date")) <= F.lit(last_cutoff).cast("date"))
    return rows.orderBy(D.month_index(D.cutoff_date(F.col("cutoff_date"))), "future_paper_published_date", "future_paper_id")


def records(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """JSON files of one record each, or one a line; corrupt ones are skipped."""
    return spark.read.schema(RECORD).option("multiLine", one_per_file).option("mode", "DROPMALFORMED").json(path)


def artifact_windows(spark: SparkSession, paths: list[str], one_per_file: bool = True) -> DataFrame:
    """One row per topic and window of result artifacts: strategy, model, topic, counts and metrics."""
    a = spark.read.schema(ARTIFACT).option("multiLine", one_per_file).option("mode", "DROPMALFORMED").json(paths)
    return windows_of(a)


def windows_of(artifacts: DataFrame) -> DataFrame:
    topics = artifacts.select("strategy", "model_name", F.explode("topic_results").alias("topic_id", "r"))
    w = topics.select("strategy", "model_name", "topic_id", F.explode("r.windows").alias("w"))
    return w.select("strategy", "model_name", "topic_id", "w.cutoff_date", "w.train_count", "w.future_count", "w.evaluation")


def topics_yaml(spark: SparkSession, path: str) -> DataFrame:
    """A YAML list of topics (id, name, aliases, keywords) as a small dimension; needs PyYAML."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML needs PyYAML") from e
    with open(path) as f:
        loaded = yaml.safe_load(f)
    rows = [(str(t["id"]), str(t.get("name", t["id"])), list(t.get("aliases") or []), list(t.get("keywords") or [])) for t in (loaded["topics"] if isinstance(loaded, dict) else loaded)]
    return spark.createDataFrame(rows, "topic_id string, topic_name string, aliases array<string>, keywords array<string>")


def index(spark: SparkSession, path: str, kind: str, cutoff: str) -> DataFrame:
    """The vectors of one index of a table partitioned by kind and cutoff."""
    return spark.read.parquet(path).filter((F.col("kind") == kind) & (F.col("cutoff") == cutoff))


TRAINING_ROW = T.StructType([T.StructField(n, T.StringType()) for n in ("data_source", "prompt", "ground_truth", "extra_info")])
RUBRIC = T.StructType([T.StructField("topic_id", T.StringType()), T.StructField("version", T.IntegerType()), *(T.StructField(n, T.ArrayType(T.StringType())) for n in ("operator_focus", "criteria", "must_not"))])
EPISODE = T.StructType([*(T.StructField(n, T.StringType()) for n in ("topic_id", "episode_id", "split", "cutoff_date")), T.StructField("train_paper_ids", T.ArrayType(T.StringType())), T.StructField("future_paper_ids", T.ArrayType(T.StringType()))])


def latest_rubrics(rubrics: DataFrame) -> DataFrame:
    """The last version of each topic's rubric."""
    return rubrics.groupBy("topic_id").agg(F.max_by(F.struct(*rubrics.columns), "version").alias("r")).select("r.*")


def batch_results(lines: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Results and failures of a batch job's lines of JSON: custom_id with its parts and content, and custom_id with the reason."""
    schema = "custom_id string, response struct<status_code:int,body:struct<choices:array<struct<message:struct<content:string>>>>>, error struct<message:string>"
    r = lines.select(F.from_json(value, schema).alias("r")).select("r.*")
    content = F.get(F.col("response.body.choices"), F.lit(0))["message"]["content"]
    ok = (F.col("response.status_code") == 200) & content.isNotNull()
    part = F.split("custom_id", r"\|")
    good = r.filter(ok).select("custom_id", F.get(part, F.lit(0)).alias("topic_id"), F.get(part, F.lit(1)).alias("episode_id"), F.get(part, F.lit(2)).alias("paper_id"), content.alias("content"))
    bad = r.filter(~F.coalesce(ok, F.lit(False))).select("custom_id", F.coalesce("error.message", F.concat(F.lit("status "), F.col("response.status_code").cast("string")), F.lit("malformed")).alias("reason"))
    return good, bad
