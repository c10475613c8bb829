"""Sources: record lists, manifests, score tables, trial trees, episode folders, API payloads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.literature import latest

MESSAGES = "array<struct<role:string,content:string>>"
_ROLES = {"human": "user", "user": "user", "gpt": "assistant", "assistant": "assistant", "system": "system"}


def guard(df: DataFrame, wrong: Column, message: str) -> DataFrame:
    """df, failing loudly at run time where `wrong` holds."""
    return df.where(F.when(wrong, F.raise_error(F.lit(message)).cast("boolean")).otherwise(True))


def unique(df: DataFrame, *keys: str) -> DataFrame:
    """df, failing on a repeated key."""
    n = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    return df.join(guard(n, F.col("_n") > 1, f"duplicate {', '.join(keys)}").drop("_n"), list(keys))


def at_path(df: DataFrame, path: str) -> Column:
    """The value at a dotted path of the schema."""
    return F.col(path).cast("string")


def messages_of(df: DataFrame) -> Column:
    """Messages of either record form, roles mapped to user, assistant and system, other roles left out."""
    names = F.create_map(*(F.lit(x) for kv in _ROLES.items() for x in kv))
    message = lambda role, text: lambda m: F.struct(names[m[role]].alias("role"), m[text].alias("content"))
    forms = []
    for column, role, text in (("messages", "role", "content"), ("conversations", "from", "value")):
        if column in df.columns:
            forms.append(F.transform(column, message(role, text)))
    if not forms:
        raise ValueError("records have neither messages nor conversations")
    return F.filter(F.coalesce(*forms), lambda m: m["role"].isNotNull()).cast(MESSAGES)


def record_list(spark: SparkSession, path: str, teacher: str, id_path: str, strict: bool = False) -> DataFrame:
    """(teacher, task, row_idx, messages) of a JSON list; the last record of a task wins, or strict raises."""
    raw = spark.read.option("multiLine", True).json(path)
    rows = raw.select(F.lit(teacher).alias("teacher"), at_path(raw, id_path).alias("task"), F.monotonically_increasing_id().alias("row_idx"), messages_of(raw).alias("messages")).where("task is not null")
    return unique(rows, "task") if strict else latest(rows, "task", "row_idx").select(*rows.columns)


def manifest(spark: SparkSession, path: str, kind: str = "task_manifest_header") -> tuple[dict, DataFrame]:
    """The header of a JSON-lines manifest, and its tasks."""
    lines = spark.read.text(path).select(F.col("value"), F.get_json_object("value", "$.kind").alias("kind"))
    head = lines.where(F.col("kind") == kind).first()
    if head is None:
        raise ValueError(f"no {kind} in {path}")
    import json

    body = lines.where(F.coalesce(F.col("kind") != kind, F.lit(True))).select(F.from_json("value", "task_id string, task_dir string, teacher_record_index map<string,int>").alias("r")).select("r.*")
    return json.loads(head.value), body


def score_lines(spark: SparkSession, path: str) -> DataFrame:
    """Score rows as JSON lines under an explicit schema."""
    return spark.read.schema("proxy string, teacher string, task_id string, score double, score_views map<string,double>, ratio_num double, ratio_den double, missing boolean, meta struct<direction:string,aggregation:string>").json(path)


def score_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet scores with pruned columns, or JSON lines whose older names are accepted; NaN and infinities are refused."""
    if path.endswith(".parquet"):
        out = spark.read.parquet(path).select("trajectory_id", "task_id", "rsr_b", "num_tokens_masked")
    else:
        raw = spark.read.schema("trajectory_id string, task_id string, rsr_b double, score double, num_tokens_masked long, assistant_tokens_scored long").json(path)
        out = raw.select("trajectory_id", "task_id", F.coalesce("rsr_b", "score").alias("rsr_b"), F.coalesce("num_tokens_masked", "assistant_tokens_scored").alias("num_tokens_masked"))
    bad = F.col("rsr_b").isNull() | F.isnan("rsr_b") | (F.abs("rsr_b") == float("inf"))
    return unique(guard(out, bad, "score is not finite"), "task_id")


def token_audit(spark: SparkSession, path: str) -> DataFrame:
    out = spark.read.parquet(path).select("trajectory_id", "task_id", "sft_total_tokens", "sft_trainable_tokens", "sft_turns_truncated")
    wrong = F.expr("not coalesce(sft_trainable_tokens between 1 and sft_total_tokens and sft_turns_truncated >= 0, false)")
    return unique(guard(out, wrong, "token counts are inconsistent"), "task_id")


def agreed(sidecars: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The one record of provenance that all sidecars agree on; raises where they differ."""
    counts = sidecars.agg(*(F.countDistinct(f).alias(f"n_{f}") for f in fields), *(F.first(f).alias(f) for f in fields))
    differ = F.lit(False)
    for f in fields:
        differ |= F.col(f"n_{f}") > 1
    return guard(counts, differ, "provenance differs").select(*fields)


def trials(spark: SparkSession, root: str) -> DataFrame:
    """All result.json below a root; corrupt and foreign files are passed over."""
    shape = "task_name string, verifier_result struct<rewards:struct<reward:double>>, exception_info struct<exception_type:string>, _corrupt_record string"
    raw = spark.read.schema(shape).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "result.json").json(root)
    return raw.select("task_name", F.col("verifier_result.rewards.reward").alias("reward"), F.col("exception_info.exception_type").alias("exception"), F.col("_metadata.file_path").alias("path")).where("task_name is not null")


def best_trials(found: DataFrame) -> DataFrame:
    """One trial per task: the first clean one by path, else the last failed one."""
    clean = F.col("exception").isNull()
    first = F.min_by(F.struct("reward", "exception", "path"), F.when(clean, F.col("path")))
    last = F.max_by(F.struct("reward", "exception", "path"), F.when(~clean, F.col("path")))
    return found.groupBy("task_name").agg(F.coalesce(first, last).alias("t")).select("task_name", "t.*")


def episodes(spark: SparkSession, root: str, name: str = "prompt.txt") -> DataFrame:
    """Texts of episode-N folders below a root: (trial, episode, text), episode as a number."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", name).text(root)
    path = F.col("_metadata.file_path")
    return files.select(F.regexp_extract(path, r"([^/]+)/(?:agent/)?episode-\d+/", 1).alias("trial"), F.regexp_extract(path, r"/episode-(\d+)/", 1).cast("int").alias("episode"), F.col("value").alias("text"))


def instructions(spark: SparkSession, root: str, name: str = "instruction.md") -> DataFrame:
    """Evaluation texts: (eval_id, text), the id being the folder below the root."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", name).text(root)
    start = root.rstrip("/").rpartition("/")[2]
    return files.select(F.regexp_extract("_metadata.file_path", rf"/{start}/(.+)/[^/]+$", 1).alias("eval_id"), F.col("value").alias("text"))


def match_files(files: DataFrame, teachers: DataFrame, prefix: str = "claude") -> DataFrame:
    """Each teacher's file by normalised substring, the vendor prefix left out; anything but one match raises."""
    norm = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    wanted = F.regexp_replace(norm(F.col("teacher")), f"^{prefix}", "")
    j = teachers.join(F.broadcast(files), F.contains(norm(F.col("file")), wanted), "left")
    n = j.groupBy("teacher").agg(F.count("file").alias("n"), F.first("file").alias("file"))
    return guard(n, F.col("n") != 1, "a teacher matches no file or several").select("teacher", "file")


def id_field(schema_fields: Sequence[str], candidates: Sequence[str]) -> str:
    """The first candidate present, under metadata before the top level."""
    for c in candidates:
        for full in (f"metadata.{c}", c):
            if full in schema_fields:
                return full
    raise ValueError("no id field")


def atom_entries(feeds: DataFrame, column: str = "xml") -> DataFrame:
    """Entries of Atom feeds: (url, title, abstract, year)."""
    cols = {"url": "id", "title": "title", "abstract": "summary", "published": "published"}
    zipped = F.arrays_zip(*(F.xpath(column, F.lit(f"/feed/entry/{tag}/text()")).alias(name) for name, tag in cols.items()))
    return feeds.select(F.explode(zipped).alias("e")).select("e.url", F.trim(F.regexp_replace("e.title", r"\s+", " ")).alias("title"), F.trim(F.regexp_replace("e.abstract", r"\s+", " ")).alias("abstract"), F.substring("e.published", 1, 4).cast("int").alias("year"))


def works(payloads: DataFrame, column: str = "body") -> DataFrame:
    """Works of a scholarly API: (id, title, year, inverted), the abstract still as an inverted index."""
    shape = "results array<struct<id:string,title:string,publication_year:int,abstract_inverted_index:map<string,array<int>>>>"
    return payloads.select(F.explode(F.from_json(column, shape)["results"]).alias("w")).select("w.id", "w.title", F.col("w.publication_year").alias("year"), F.col("w.abstract_inverted_index").alias("inverted"))


def cached_pages(cache: DataFrame, wanted: DataFrame) -> DataFrame:
    """Bodies of the URLs asked for from a cache table (url, status, body); only status 200 counts."""
    return wanted.select("url").distinct().join(cache.where("status = 200"), "url")


_CANDIDATE = ("key", "arxiv_id", "url", "title", "abstract", "year", "sources", "tags", "hops")


def _paper(arxiv: Column, source: Column, tag: Column | None = None, title: Column | None = None, abstract: Column | None = None, year: Column | None = None, url: Column | None = None, hops: int = 0) -> list[Column]:
    none = F.lit(None).cast("string")
    link = F.when(arxiv.isNotNull(), F.concat(F.lit("https://arxiv.org/abs/"), arxiv)).otherwise(none if url is None else url)
    key = F.when(arxiv.isNotNull(), F.concat(F.lit("arxiv:"), arxiv)).otherwise(F.concat(F.lit("url:"), link))
    tags = F.array().cast("array<string>") if tag is None else F.array(tag)
    columns = (key, arxiv, link, F.coalesce(none if title is None else title, F.lit("")), F.coalesce(none if abstract is None else abstract, F.lit("")), F.lit(None).cast("int") if year is None else year, F.array(source), tags, F.lit(hops))
    return [c.alias(n) for c, n in zip(columns, _CANDIDATE, strict=True)]


def _arxiv(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(\d{4}\.\d{4,5})", 1), F.lit(""))


def dataset_cards(payloads: DataFrame, column: str = "body", source: str = "source") -> DataFrame:
    """Candidates from a dataset hub's search results: one for each paper that a card's tags cite."""
    d = payloads.select(F.col(source).alias("_s"), F.explode(F.from_json(column, "array<struct<id:string,tags:array<string>>>")).alias("d"))
    cited = d.select("_s", "d.id", F.explode(F.filter("d.tags", lambda t: F.startswith(t, F.lit("arxiv:")))).alias("t"))
    return cited.select(*_paper(_arxiv(F.col("t")), F.col("_s"), F.concat(F.lit("hf_dataset:"), F.col("id")))).where("arxiv_id is not null")


def code_repositories(payloads: DataFrame, column: str = "body", source: str = "source") -> DataFrame:
    """Candidates from a code host's search results: repositories whose description or home page names a paper."""
    shape = "items array<struct<full_name:string,description:string,homepage:string>>"
    r = payloads.select(F.col(source).alias("_s"), F.explode(F.from_json(column, shape)["items"]).alias("r")).withColumn("_t", F.concat_ws(" ", "r.description", "r.homepage"))
    return r.where(F.contains(F.lower("_t"), F.lit("arxiv"))).select(*_paper(_arxiv(F.col("_t")), F.col("_s"), F.concat(F.lit("github_repo:"), F.col("r.full_name")))).where("arxiv_id is not null")


def citations(payloads: DataFrame, column: str = "body", source: str = "source", hops: int = 1) -> DataFrame:
    """Candidates from a citation graph's pages of citing or cited papers; one with neither preprint nor URL is left out."""
    paper = "struct<title:string,abstract:string,year:int,url:string,externalIds:struct<ArXiv:string>>"
    rows = payloads.select(F.col(source).alias("_s"), F.explode(F.from_json(column, f"data array<struct<citingPaper:{paper},citedPaper:{paper}>>")["data"]).alias("x"))
    p = rows.select("_s", F.coalesce("x.citingPaper", "x.citedPaper").alias("p"))
    return p.select(*_paper(F.col("p.externalIds.ArXiv"), F.col("_s"), None, F.col("p.title"), F.col("p.abstract"), F.col("p.year"), F.col("p.url"), hops)).where("url is not null")


def pdf_pages(files: DataFrame) -> DataFrame:
    """(path, text) of a binaryFile table of PDFs, pages marked [page n]; needs pypdf on the executors and fails without it."""

    def read(batches):
        import io

        import pandas as pd
        from pypdf import PdfReader

        for b in batches:
            yield pd.DataFrame({"path": b.path, "text": ["\n".join(f"[page {i}]\n{p.extract_text() or ''}" for i, p in enumerate(PdfReader(io.BytesIO(c)).pages, 1)) for c in b.content]})

    return files.select("path", "content").mapInPandas(read, "path string, text string")
