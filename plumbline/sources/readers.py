"""Readers and sinks for files: raw JSON, JSON lines with envelopes, series, typed columns, reports."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RAW = (
    "id string, title string, description string, created string, company struct<display_name:string>,"
    " location struct<display_name:string, area:array<string>>, category struct<label:string, tag:string>,"
    " latitude double, longitude double, salary_min double, salary_max double, salary_is_predicted string,"
    " contract_type string, contract_time string"
)
COLLECTION = (
    "run_id string, collected_at string, source string, country string, query_variant string, query_role string,"
    " domain string, adzuna_id string, page int, position int"
)
CORRUPT = "_corrupt_record"


def redacted(message: str) -> str:
    """A message without the values of keys and tokens in it."""
    return re.sub(r"(?i)\b((?:app_?id|app_?key|api_?key|key|token|secret|password)=)[^&\s\"']+", r"\1***", message)


def _struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl) if hasattr(T.StructType, "fromDDL") else T._parse_datatype_string(ddl)


def envelope_schema() -> T.StructType:
    """``collection`` and ``raw``, and the text of lines that don't parse."""
    return T.StructType([
        T.StructField("collection", _struct(COLLECTION)), T.StructField("raw", _struct(RAW)), T.StructField(CORRUPT, T.StringType())
    ])


def discover(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """``path, name, run_dir, bytes``: the files under ``root`` whose names match, by path; contents aren't read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return f.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.element_at(F.split("path", "/"), -2).alias("run_dir"), F.col("length").alias("bytes"))


def json_arrays(spark: SparkSession, root: str, pattern: str = "*.json") -> DataFrame:
    """Records of files that hold one JSON array each, with ``file``, and the query and date their names end in.

    Files and records that can't be read come out of :func:`json_array_faults`.
    """
    schema = _struct(RAW).add(CORRUPT, T.StringType())
    r = spark.read.schema(schema).option("multiLine", "true").option("pathGlobFilter", pattern).option("columnNameOfCorruptRecord", CORRUPT).json(root)
    name = F.col("_metadata.file_name")
    r = r.select("*", name.alias("file")).filter(F.col(CORRUPT).isNull()).drop(CORRUPT)
    return r.withColumns({
        "file_query": F.nullif(F.regexp_extract("file", r"_(.+)_\d{4}-\d{2}-\d{2}\.json$", 1), F.lit("")),
        "file_date": F.expr("try_cast(nullif(regexp_extract(file, '(\\\\d{4}-\\\\d{2}-\\\\d{2})\\\\.json$', 1), '') as date)"),
    })


def json_array_faults(spark: SparkSession, root: str, pattern: str = "*.json") -> DataFrame:
    """``file, line, reason`` of what :func:`json_arrays` leaves out: files that don't parse (``line`` null) and elements that are no object."""
    whole = spark.read.option("wholetext", "true").option("pathGlobFilter", pattern).text(root)
    t = whole.select(F.col("_metadata.file_name").alias("file"), F.try_parse_json("value").alias("v"))
    kind = F.schema_of_variant("v")
    parts = F.try_variant_get("v", "$", "array<variant>")
    none = t.filter("v is null").select("file", F.lit(None).cast("int").alias("line"), F.lit("unreadable file").alias("reason"))
    other = t.filter("v is not null").filter(~kind.startswith("ARRAY")).select("file", F.lit(None).cast("int"), F.lit("no array"))
    odd = t.filter("v is not null").filter(kind.startswith("ARRAY")).select("file", F.posexplode(parts).alias("line", "e"))
    odd = odd.filter(~F.schema_of_variant("e").startswith("OBJECT")).select("file", "line", F.lit("record is not an object"))
    return none.union(other).union(odd)


def envelopes(spark: SparkSession, root: str, pattern: str = "records_*.jsonl") -> tuple[DataFrame, DataFrame]:
    """The good envelopes, with ``file``, and the lines that hold none as ``file, line``; blank lines are neither.

    A field of the wrong kind is null in an otherwise good envelope.
    """
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root)
    r = lines.select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("line")).filter(F.trim("line") != "")
    r = r.withColumn("e", F.from_json("line", envelope_schema(), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}))
    some = F.col("e.collection").isNotNull() | F.col("e.raw").isNotNull()
    return r.filter(some).select("e.collection", "e.raw", "file"), r.filter(~some).select("file", "line")


def with_query_log(rows: DataFrame, log: DataFrame) -> DataFrame:
    """``rows`` with the metadata of the query that wrote their file, null where the log has none."""
    meta = log.groupBy(F.col("records_file").alias("_f")).agg(*[F.first(c, ignorenulls=True).alias(f"log_{c}") for c in log.columns if c != "records_file"])
    return rows.join(meta, F.col("file") == F.col("_f"), "left").drop("_f")


def flat(rows: DataFrame) -> DataFrame:
    """Envelopes as flat typed columns; blank strings become null."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    r = "raw."
    return rows.select(
        blank("collection.adzuna_id").alias("job_id"), blank("collection.run_id").alias("run_id"), F.col("collection.collected_at").alias("collected_at"),
        blank(r + "title").alias("title"), blank(r + "description").alias("description"), blank(r + "company.display_name").alias("employer"),
        blank(r + "location.display_name").alias("location"), F.col(r + "location.area").alias("area"), blank(r + "category.tag").alias("category_tag"),
        F.col(r + "latitude").alias("latitude"), F.col(r + "longitude").alias("longitude"), F.col(r + "salary_min").alias("value_lo"), F.col(r + "salary_max").alias("value_hi"),
        blank(r + "created").alias("created"), F.col(r + "salary_is_predicted").alias("value_is_predicted"),
    )


def latest(df: DataFrame, c: str) -> DataFrame:
    """The rows of the largest value of ``c``: the last run, partition or pull."""
    top = df.agg(F.max(c)).first()[0]  # one value
    return df.filter(F.col(c) == F.lit(top)) if top is not None else df.limit(0)


def weekly_series(spark: SparkSession, path: str) -> DataFrame:
    """``date, name, value``: a wide CSV in long form; unreadable dates and partial weeks are dropped."""
    raw = spark.read.option("header", "true").csv(path)
    partial = F.upper(F.coalesce("isPartial", F.lit("FALSE"))) != "TRUE" if "isPartial" in raw.columns else F.lit(True)
    names = [c for c in raw.columns if c not in ("date", "isPartial")]
    kept = raw.filter(partial).withColumn("date", F.expr("try_cast(date as date)")).filter("date is not null")
    return kept.unpivot(["date"], names, "name", "text").select("date", "name", F.expr("try_cast(text as double)").alias("value"))


def typed_extract(spark: SparkSession, path: str, out: str) -> DataFrame:
    """A CSV as typed Parquet: columns whose name ends in ``date`` become dates, others what their values are; NaN becomes null."""
    raw = spark.read.option("header", "true").option("inferSchema", "true").csv(path)
    cols = []
    for name, kind in raw.dtypes:
        c = F.col(f"`{name}`")
        if name.lower().endswith("date"):
            c = c.try_cast("date")
        elif kind == "double":
            c = F.when(~F.isnan(c), c)
        cols.append(c.alias(name))
    raw.select(*cols).write.mode("overwrite").option("compression", "zstd").parquet(out)
    return spark.read.parquet(out)


def write_table(df: DataFrame, path: str) -> None:
    """A zstd Parquet table."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_sorted_csv(df: DataFrame, path: str, order: Sequence[Column]) -> None:
    """A CSV whose bytes depend on the rows only: sorted, lists as JSON, doubles in ten digits."""
    cols = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind.startswith(("array", "struct", "map")):
            c = F.to_json(c)
        elif kind in ("double", "float"):
            c = F.format_string("%.10g", c)
        cols.append(c.alias(name))
    df.orderBy(*order).select(*cols).write.mode("overwrite").option("header", "true").option("lineSep", "\n").csv(path)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Heterogeneous frames under the ordered union of their columns."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def write_report(path: str, report: Mapping[str, object]) -> None:
    """A small report as sorted JSON."""
    tmp = f"{path}.new"
    with open(tmp, "w", encoding="utf-8") as f:
        json.dump(report, f, sort_keys=True, indent=2, default=str)
    os.replace(tmp, path)


def content_digest(df: DataFrame) -> tuple[int, int]:
    """Row count and an order-free 64-bit digest."""
    h = F.expr(f"bit_xor(xxhash64({', '.join(f'`{c}`' for c in df.columns)}))")
    r = df.agg(F.count(F.lit(1)), h).first()
    return int(r[0]), int(r[1] or 0)


def file_digests(spark: SparkSession, root: str) -> DataFrame:
    """``path, sha256`` of every file: taken before and after a build, they show that inputs stayed as they were."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.sha2("content", 256).alias("sha256"))


def expand_queries(plans: DataFrame) -> DataFrame:
    """``role, country, query, max_records``: each role's countries times its variants; a variant's own cap goes first.

    ``plans`` has ``role, countries array<string>, variants array<struct<query, max_records>>, max_records``.
    """
    p = plans.select("role", F.explode("countries").alias("country"), "variants", F.col("max_records").alias("_d"))
    p = p.select("role", "country", "_d", F.explode("variants").alias("v"))
    return p.select("role", "country", "v.query", F.coalesce("v.max_records", "_d").alias("max_records"))


def systematic_sample(df: DataFrame, order: str, windows: int, size: int) -> DataFrame:
    """``windows`` evenly spaced runs of ``size`` rows under ``order``: a sampling operator.

    Places are counted per range partition and offset by the partitions before, so no
    task sorts the whole table.
    """
    from plumbline.session import cut_lineage, shuffle_width

    parts = cut_lineage(df.repartitionByRange(shuffle_width(df.sparkSession), order).withColumn("_p", F.spark_partition_id()))
    sizes = sorted(parts.groupBy("_p").count().collect())  # a number for each partition
    start, starts = 0, []
    for p, n in sizes:
        starts.append((p, start))
        start += n
    from pyspark.sql import Window

    offs = df.sparkSession.createDataFrame(starts or [(0, 0)], "_p int, _o bigint")
    i = parts.join(F.broadcast(offs), "_p").withColumn("_i", F.col("_o") + F.row_number().over(Window.partitionBy("_p").orderBy(order)) - 1)
    step = max(1, start // max(1, windows))
    return i.filter((F.pmod("_i", F.lit(step)) < size) & (F.floor(F.col("_i") / step) < windows)).drop("_p", "_o", "_i")


class ReplaySource(DataSource):
    """Pages of a paged service, replayed from JSON-line files: one partition per query file, read page by page.

    Options: ``path`` (a folder of ``*.jsonl``), ``max_records`` per query. Stops a query
    at an empty page or its cap. What a network reader would add is its own retries.
    """

    @classmethod
    def name(cls) -> str:
        return "replay"

    def schema(self) -> str:
        return "query string, page int, position int, body string"

    def reader(self, schema) -> DataSourceReader:
        return _ReplayReader(self.options)


class _ReplayReader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]):
        self.path = options["path"].removeprefix("file://")
        self.cap = int(options.get("max_records", "1000000000"))
        self.page = int(options.get("page_size", "50"))

    def partitions(self) -> Sequence[InputPartition]:
        return [InputPartition(os.path.join(self.path, f)) for f in sorted(os.listdir(self.path)) if f.endswith(".jsonl")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        name = os.path.basename(partition.value)[: -len(".jsonl")]
        n = 0
        with open(partition.value, encoding="utf-8") as f:
            for line in f:
                if not line.strip():
                    continue
                if n >= self.cap:
                    return
                yield name, n // self.page + 1, n % self.page + 1, line.rstrip("\n")
                n += 1


class Retry:
    """Calls with exponential delays.

    Statuses in ``retryable``, timeouts and lost connections (``OSError``), and a 200
    whose body is no JSON are tried again, at most ``most`` calls in all; other statuses
    fail at once. A Retry-After is the least delay; ``jitter`` gives a part of a second
    more. What is logged has no secrets: ``redact`` rewrites messages.
    """

    def __init__(self, sleep, retryable: Sequence[int] = (429, 500, 502, 503, 504), most: int = 4, base: float = 1.0, ceiling: float = 120.0, jitter=lambda: 0.0, redact=redacted):
        self.sleep, self.retryable, self.most, self.base, self.ceiling = sleep, set(retryable), most, base, ceiling
        self.jitter, self.redact = jitter, redact
        self.log: list[dict] = []
        self.failures = self.retries = 0
        self.stop_reason: str | None = None

    def call(self, request, parse=lambda body: body):
        """``request()`` gives ``(status, body, retry_after)``; the parsed body of the first success, or None."""
        for attempt in range(self.most):
            after, status, error, body = None, None, None, None
            try:
                status, body, after = request()
            except OSError as e:  # timeouts and lost connections are OSErrors
                error = f"{type(e).__name__}: {e}"
            if status == 200:
                try:
                    body = parse(body)
                except ValueError as e:
                    error, status = f"bad body: {e}", None
                else:
                    if self.failures:
                        self.log.append({"attempt": attempt + 1, "outcome": "recovered"})
                    return body
            self.failures += 1
            passing = error is not None or status in self.retryable
            again = passing and attempt < self.most - 1
            entry = {"attempt": attempt + 1, "status": status, "will_retry": again}
            self.log.append(entry | ({"error": self.redact(error)} if error else {}))
            if not again:
                self.stop_reason = "retries_exhausted" if passing else f"non_retryable_http_{status}"
                return None
            self.retries += 1
            self.sleep(min(self.ceiling, max(after or 0.0, self.base * 2**attempt)) + self.jitter())
        return None


class RateLimiter:
    """At least ``interval`` seconds between calls, by the given clock."""

    def __init__(self, interval: float, clock, sleep):
        self.interval, self.clock, self.sleep = interval, clock, sleep
        self._last: float | None = None

    def wait(self) -> None:
        if self._last is not None and (left := self._last + self.interval - self.clock()) > 0:
            self.sleep(left)
        self._last = self.clock()


def anchor_batches(names: Sequence[str], anchor: str, size: int = 4) -> list[list[str]]:
    """The names in batches of ``size``, each with the anchor that makes batches comparable; the anchor itself is in all."""
    rest = [n for n in dict.fromkeys(names) if n != anchor]
    return [[anchor, *rest[i : i + size]] for i in range(0, max(1, len(rest)), size)]


def relabel(df: DataFrame, labels: Mapping[str, str]) -> DataFrame:
    """``df`` with columns renamed from topic ids to labels; two columns of one label are an error."""
    new = [labels.get(c, c) for c in df.columns]
    if len(set(new)) < len(new):
        raise ValueError("two columns have one label")
    return df.toDF(*new)


class Run:
    """A run's own folder: made once, pages are appended, nothing is ever overwritten."""

    def __init__(self, spark: SparkSession, root: str, run_id: str):
        self.spark, self.path = spark, f"{root.rstrip('/')}/{run_id}"
        jvm = spark._jvm
        self._fs = jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        if self._fs.exists(self._at("")):
            raise FileExistsError(self.path)
        self._fs.mkdirs(self._at(""))

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def append(self, page: int, lines: Sequence[str]) -> None:
        """One page's envelopes as a JSON-lines file; a page that is there already is an error."""
        stream = self._fs.create(self._at(f"records_page{page:05d}.jsonl"), False)
        try:
            stream.write("".join(line + "\n" for line in lines).encode())
        finally:
            stream.close()


def write_page(path: str, template: str, payload: Mapping[str, object], grid: str, points: int) -> None:
    """A static page: ``template`` with ``{{data}}`` replaced by the payload as JSON; every row of ``payload[grid]`` has ``points`` values."""
    for name, row in dict(payload[grid]).items():
        if len(row) != points:
            raise ValueError(f"{grid}.{name} has {len(row)} values, not {points}")
    body = json.dumps(payload, sort_keys=True, default=str).replace("</", "<\\/")
    tmp = f"{path}.new"
    with open(tmp, "w", encoding="utf-8") as f:
        f.write(template.replace("{{data}}", body))
    os.replace(tmp, path)
