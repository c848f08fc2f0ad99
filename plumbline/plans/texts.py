"""Queries of text, date, array, JSON and deduplication functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.functions import rules, text
from plumbline.operators import dedup
from plumbline.plans.registry import Registry
from plumbline.sources.tables import instant, table

q = Registry()
QUERIES, SQL = q.queries, q.sql

_NORM = "trim(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9]+', ' ', 'g'))"
_TITLE = "trim(regexp_replace(lower(regexp_replace(nfc_normalize(coalesce({0}, '')), '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9]+', ' ', 'g'))"
_DESC = """lower(trim(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(coalesce({0}, ''), '[\\x{{200B}}\\x{{200C}}\\x{{200D}}\\x{{2060}}\\x{{FEFF}}]', '', 'g'),
    '[\\x{{00}}-\\x{{1F}}\\x{{7F}}-\\x{{9F}}]', ' ', 'g'), '[\\s\\x{{0B}}\\p{{Z}}]+', ' ', 'g')), '(\\.\\.\\.|…)\\s*$', '')))"""


@q("norm_text", f"SELECT DISTINCT employer, {_NORM.format('employer')} AS normal FROM employer_cap_exclusions")
def norm_text(s, d):
    return table(s, d, "employer_cap_exclusions").select("employer", text.norm_text(F.col("employer")).alias("normal")).distinct()


@q("norm_title", f"SELECT DISTINCT raw.title AS title, {_NORM.format('strip_accents(raw.title)')} AS normal FROM records_project_manager__scrum_master")
def norm_title(s, d):
    return table(s, d, "records_project_manager__scrum_master").select("raw.title").distinct().select("title", text.norm_title(F.col("title")).alias("normal"))


@q("norm_description")
def norm_description(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(text.norm_description(F.col("text"))).alias("digest"))


@q("clean_text", """SELECT doc_id, md5(trim(regexp_replace(lower(regexp_replace(regexp_replace(coalesce(text, ''), 'https?://\\S+|www\\.\\S+', ' ', 'g'), '[\\w.+-]+@[\\w-]+\\.[\\w.-]+', ' ', 'g')),
    '[\\s\\x{0B}\\x{85}\\p{Z}]+', ' ', 'g'))) AS digest FROM documents""")
def clean_text(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(text.clean_text(F.col("text"))).alias("digest"))


@q("strip_markup", """SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(regexp_replace(coalesce(text, ''), '<[^>]*>', ' ', 'g')), '[^a-z0-9+#./\\s-]', ' ', 'g'), '[\\s\\x{0B}]+', ' ', 'g'))) AS digest FROM documents""")
def strip_markup(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(text.strip_markup(F.col("text"))).alias("digest"))


@q("decode_entities")
def decode_entities(s, d):
    """Every description, those that end in an unfinished entity too."""
    r = table(s, d, "records_graphic_designer__visual_designer").select("collection.run_id", "raw.description").filter("description is not null")
    return r.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(text.decode_entities(F.col("description")))).alias("chars"))


@q("whole_words", """SELECT doc_id, regexp_matches(lower(text), '(^|[^a-z0-9+#])risk logs([^a-z0-9+#]|$)') AS risk, regexp_matches(lower(text), '(^|[^a-z])status[ _-]*mails([^a-z]|$)') AS mails FROM documents WHERE text IS NOT NULL""")
def whole_words(s, d):
    low = F.lower("text")
    return table(s, d, "documents").filter("text is not null").select("doc_id", text.has_word(low, "risk logs").alias("risk"), text.loose_word(low, "status mails").alias("mails"))


@q("pattern_dictionary", """SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)sketch') THEN 'sketch' WHEN regexp_matches(text, '(?i)board([^a-z]|$)') THEN 'board' WHEN regexp_matches(text, '(?i)flow([^a-z]|$)') THEN 'flow' ELSE 'none' END AS tool FROM documents""")
def pattern_dictionary(s, d):
    return table(s, d, "documents").select("doc_id", text.first_match(F.col("text"), {"sketch": "sketch", "board": "board([^a-z]|$)", "flow": "flow([^a-z]|$)"}, "none").alias("tool"))


SENIORITY = {"lead": r"\b(lead|head|principal)\b", "senior": r"\b(senior|sr)\b", "junior": r"\b(junior|jr|associate|fresher)\b"}


@q("seniority", """SELECT DISTINCT raw.title AS title, CASE WHEN regexp_matches(raw.title, '(?i)\\b(lead|head|principal)\\b') THEN 'lead' WHEN regexp_matches(raw.title, '(?i)\\b(senior|sr)\\b') THEN 'senior'
    WHEN regexp_matches(raw.title, '(?i)\\b(junior|jr|associate|fresher)\\b') THEN 'junior' ELSE 'mid' END AS level FROM records_project_manager__scrum_master""")
def seniority(s, d):
    return table(s, d, "records_project_manager__scrum_master").select("raw.title").distinct().select("title", text.first_match(F.col("title"), SENIORITY, "mid").alias("level"))


@q("years_of_experience", """SELECT DISTINCT raw.title AS title, try_cast(nullif(regexp_extract(lower(raw.title), '(\\d{1,2})-\\d+ years', 1), '') AS INTEGER) AS years FROM records_project_manager__scrum_master""")
def years_of_experience(s, d):
    return table(s, d, "records_project_manager__scrum_master").select("raw.title").distinct().select("title", text.first_number(F.col("title"), r"(\d{1,2})-\d+ years").alias("years"))


@q("ordered_patterns", """SELECT DISTINCT raw.title AS title, CASE WHEN regexp_matches(raw.title, '(?i)hybrid') THEN 'hybrid' WHEN regexp_matches(raw.title, '(?i)remote|work from home') THEN 'remote' ELSE 'office' END AS place,
    CASE WHEN regexp_matches(raw.title, '(?i)contract|months') THEN 'contract' END AS term FROM records_project_manager__scrum_master""")
def ordered_patterns(s, d):
    t = F.col("title")
    return table(s, d, "records_project_manager__scrum_master").select("raw.title").distinct().select(
        "title", text.first_match(t, {"hybrid": "hybrid", "remote": "remote|work from home"}, "office").alias("place"), text.first_match(t, {"contract": "contract|months"}).alias("term")
    )


@q("amount_scrub", """SELECT doc_id, regexp_matches(text, '\\d{3,} hours') AS has, md5(regexp_replace(text, '\\d{3,} hours', '#', 'g')) AS digest, try_cast(nullif(regexp_extract(text, '(\\d{3,}) hours', 1), '') AS INTEGER) AS hours
    FROM documents WHERE text IS NOT NULL""")
def amount_scrub(s, d):
    t = F.col("text")
    return table(s, d, "documents").filter("text is not null").select(
        "doc_id", t.rlike(r"[0-9]{3,} hours").alias("has"), F.md5(F.regexp_replace(t, r"[0-9]{3,} hours", "#")).alias("digest"), text.first_number(t, r"([0-9]{3,}) hours").alias("hours")
    )


@q("mention_counts", """SELECT source, count(*) FILTER (regexp_matches(text, '(?i)percent')) AS percent, count(*) FILTER (regexp_matches(text, '(?i)hours')) AS hours FROM documents GROUP BY 1""")
def mention_counts(s, d):
    return table(s, d, "documents").groupBy("source").agg(F.count_if(F.col("text").rlike("(?i)percent")).alias("percent"), F.count_if(F.col("text").rlike("(?i)hours")).alias("hours"))


@q("mask_tokens", """SELECT p_partkey, array_to_string(list_filter(string_split(p_name, ' '), lambda x: x NOT IN ('small', 'red')), ' ') AS masked FROM part""")
def mask_tokens(s, d):
    return table(s, d, "part").select("p_partkey", text.mask_tokens(F.col("p_name"), ["small", "red"]).alias("masked"))


@q("prefix_lengths", "SELECT doc_id, substring(text, 1, 200) AS head, length(text)::INTEGER AS n FROM documents")
def prefix_lengths(s, d):
    return table(s, d, "documents").select("doc_id", F.substring("text", 1, 200).alias("head"), F.length("text").alias("n"))


@q("language_flag", """SELECT doc_id, CASE WHEN l > 0 THEN (l - a) / l END AS share FROM (SELECT doc_id, length(regexp_replace(text, '[^\\p{L}]', '', 'g')) AS l, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS a FROM documents)""")
def language_flag(s, d):
    return table(s, d, "documents").select("doc_id", text.foreign_share(F.col("text")).alias("share"))


@q("ending_flags", """SELECT collection.source AS source, count(*) FILTER (ends_with(rtrim(raw.description), '…')) AS ellipsis, count(*) FILTER (length(raw.description) < 200) AS short,
    count(*) FILTER (raw.description IS NULL OR trim(raw.description) = '') AS empty FROM records_graphic_designer__visual_designer GROUP BY 1""")
def ending_flags(s, d):
    t = F.col("raw.description")
    return table(s, d, "records_graphic_designer__visual_designer").groupBy(F.col("collection.source").alias("source")).agg(
        F.count_if(F.rtrim(t).endswith("…")).alias("ellipsis"), F.count_if(F.length(t) < 200).alias("short"), F.count_if(text.is_missing(t)).alias("empty")
    )


@q("slug", f"SELECT c_custkey, replace({_NORM.format('c_name')}, ' ', '_') AS slug FROM customer")
def slug(s, d):
    return table(s, d, "customer").select("c_custkey", text.slug(F.col("c_name")).alias("slug"))


@q("first_list_item", "SELECT doc_id, trim(split_part(text, ',', 1)) AS first FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(text, '^[\\s\\p{Z}]|[\\s\\p{Z}],')")
def first_list_item(s, d):
    return table(s, d, "documents").filter(r"text is not null and not text rlike '^[\\s\\p{Z}]|[\\s\\p{Z}],'").select("doc_id", F.trim(F.split_part("text", F.lit(","), F.lit(1))).alias("first"))


@q("group_key", "SELECT DISTINCT employer, regexp_replace(lower(coalesce(employer, '')), '[^a-z0-9]', '', 'g') AS k FROM employer_cap_exclusions")
def group_key(s, d):
    return table(s, d, "employer_cap_exclusions").select("employer", text.group_key(F.col("employer")).alias("k")).distinct()


@q("title_in_text", f"""SELECT raw.id AS id, contains({_NORM.format('raw.description')}, {_NORM.format('raw.title')}) AS inside FROM records_graphic_designer__visual_designer WHERE raw.title IS NOT NULL""")
def title_in_text(s, d):
    r = table(s, d, "records_graphic_designer__visual_designer").select("raw.id", "raw.title", "raw.description").filter("title is not null")
    return r.select("id", F.contains(text.norm_text(F.col("description")), text.norm_text(F.col("title"))).alias("inside"))


@q("digests", "SELECT doc_id, sha1(text) AS a, sha256(text) AS b FROM documents WHERE text IS NOT NULL")
def digests(s, d):
    return table(s, d, "documents").filter("text is not null").select("doc_id", F.sha1("text").alias("a"), F.sha2("text", 256).alias("b"))


@q("number_format", "SELECT o_orderkey, format('{:.1f} k', floor(o_totalprice / 1000)) AS label FROM orders")
def number_format(s, d):
    return table(s, d, "orders").select("o_orderkey", F.format_string("%.1f k", F.floor(F.col("o_totalprice") / 1000).cast("double")).alias("label"))


@q("redaction", "SELECT run_id, 'app_id=***&run=' || run_id AS url FROM queries")
def redaction(s, d):
    return table(s, d, "queries").select("run_id", text.redact(F.concat(F.lit("app_id=s3cret&run="), F.col("run_id"))).alias("url"))


@q("title_rules")
def title_rules(s, d):
    r = table(s, d, "records_project_manager__scrum_master").select("raw.title").distinct()
    return rules.classify(r, "title", rules.TITLE_RULES).select("title", "label", "status", "tier")


@q("theta_rule_join", f"""SELECT t.title, r.ref_id FROM (SELECT DISTINCT raw.title AS title FROM records_graphic_designer__visual_designer) t JOIN title_reference r ON contains({_NORM.format('t.title')}, {_NORM.format('r.ref_title')})""")
def theta_rule_join(s, d):
    ref = table(s, d, "title_reference").select("ref_id", text.norm_text(F.col("ref_title")).alias("phrase"))
    t = table(s, d, "records_graphic_designer__visual_designer").select("raw.title").filter("title is not null").distinct().withColumn("n", text.norm_text(F.col("title")))
    return rules.contained(t, "n", ref, "phrase").select("title", "ref_id")


@q("scope_join", """SELECT e.role, coalesce(q.domain, 'unknown') AS scope, count(*) AS n FROM employer_cap_exclusions e LEFT JOIN (SELECT query_role, min(domain) AS domain FROM queries GROUP BY 1) q ON q.query_role = e.role GROUP BY 1, 2""")
def scope_join(s, d):
    scopes = table(s, d, "queries").groupBy(F.col("query_role").alias("label")).agg(F.min("domain").alias("scope"))
    return rules.scope(table(s, d, "employer_cap_exclusions"), "role", scopes).groupBy("role", "scope").agg(F.count(F.lit(1)).alias("n"))


# dates

@q("iso_instants", "SELECT job_id, role, try_cast(nullif(trim(created), '') AS TIMESTAMPTZ) AT TIME ZONE 'UTC' AS instant FROM employer_cap_exclusions")
def iso_instants(s, d):
    return table(s, d, "employer_cap_exclusions").select("job_id", "role", instant(F.col("created")).cast("timestamp_ntz").alias("instant"))


@q("date_parts", """SELECT o_orderkey, cast(o_orderdate AS DATE) AS day, month(o_orderdate)::INTEGER AS month, date_diff('day', o_orderdate, TIMESTAMP '2002-01-01')::INTEGER AS age, floor(date_diff('day', o_orderdate, TIMESTAMP '2002-01-01') / 7)::BIGINT AS weeks FROM orders""")
def date_parts(s, d):
    age = F.datediff(F.lit("2002-01-01").cast("date"), F.to_date("o_orderdate"))
    return table(s, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), F.month("o_orderdate").alias("month"), age.alias("age"), F.floor(age / 7).alias("weeks"))


@q("monthly_means", """SELECT event_type, cast(date_trunc('month', day) AS DATE) AS month, avg(n) AS mean, count(*) AS days FROM (SELECT event_type, cast(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1, 2 HAVING count(*) >= 4""")
def monthly_means(s, d):
    n = table(s, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("event_type", F.trunc("day", "MM").alias("month")).agg(F.avg("n").alias("mean"), F.count(F.lit(1)).alias("days")).filter("days >= 4")


@q("grid_checks", """SELECT event_type, bool_and(gap IS NULL OR gap = 1) AS regular, count(*) AS days FROM (SELECT event_type, day, date_diff('day', lag(day) OVER (PARTITION BY event_type ORDER BY day), day) AS gap
    FROM (SELECT DISTINCT event_type, cast(ts AS DATE) AS day FROM events)) GROUP BY 1""")
def grid_checks(s, d):
    days = table(s, d, "events").select("event_type", F.to_date("ts").alias("day")).distinct()
    gap = F.datediff("day", F.lag("day").over(Window.partitionBy("event_type").orderBy("day")))
    return days.withColumn("gap", gap).groupBy("event_type").agg(F.bool_and(F.col("gap").isNull() | (F.col("gap") == 1)).alias("regular"), F.count(F.lit(1)).alias("days"))


@q("month_sequence", """SELECT cast(m AS DATE) AS month, count(o_orderkey) AS n FROM (SELECT unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2001-12-01', INTERVAL 1 MONTH)) AS m) LEFT JOIN orders ON date_trunc('month', o_orderdate) = m GROUP BY 1""")
def month_sequence(s, d):
    months = s.range(1).select(F.explode(F.expr("sequence(date'1995-01-01', date'2001-12-01', interval 1 month)")).alias("month"))
    n = table(s, d, "orders").groupBy(F.trunc("o_orderdate", "MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return months.join(n, "month", "left").select("month", F.coalesce("n", F.lit(0)).alias("n"))


@q("month_profile", "SELECT month(o_orderdate)::INTEGER AS month, avg(o_totalprice) AS mean FROM orders GROUP BY 1")
def month_profile(s, d):
    return table(s, d, "orders").groupBy(F.month("o_orderdate").alias("month")).agg(F.avg("o_totalprice").alias("mean"))


# numbers, arrays, JSON

@q("math_functions", "SELECT l_orderkey, l_linenumber, ln(l_quantity) AS a, ln(1 + l_discount) AS b, least(greatest(l_discount, 0.02), 0.08) AS c, sign(l_tax - 0.04)::DOUBLE AS s, round_even(l_quantity / 2, 0) AS h FROM lineitem")
def math_functions(s, d):
    c = F.col
    return table(s, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.log("l_quantity").alias("a"), F.log1p("l_discount").alias("b"), F.least(F.greatest(c("l_discount"), F.lit(0.02)), F.lit(0.08)).alias("c"),
        F.signum(c("l_tax") - 0.04).alias("s"), F.bround(c("l_quantity") / 2, 0).alias("h"),
    )


@q("median_fill", """WITH m AS (SELECT quantile_cont(raw.latitude, 0.5) AS m FROM records_graphic_designer__visual_designer) SELECT raw.id AS id, coalesce(raw.latitude, m) AS latitude FROM records_graphic_designer__visual_designer, m""")
def median_fill(s, d):
    r = table(s, d, "records_graphic_designer__visual_designer").select("raw.id", "raw.latitude")
    mid = r.agg(F.percentile("latitude", 0.5)).first()[0]  # one number
    return r.select("id", F.coalesce("latitude", F.lit(mid)).alias("latitude"))


@q("array_access", "SELECT raw.id AS id, raw.location.area[1] AS country, CASE WHEN len(raw.location.area) > 1 THEN raw.location.area[2] END AS region, coalesce(len(raw.location.area), 0)::INTEGER AS n FROM records_project_manager__scrum_master")
def array_access(s, d):
    a = F.col("raw.location.area")
    return table(s, d, "records_project_manager__scrum_master").select(
        F.col("raw.id").alias("id"), F.try_element_at(a, F.lit(1)).alias("country"), F.try_element_at(a, F.lit(2)).alias("region"), F.coalesce(F.size(a), F.lit(0)).alias("n")
    )


@q("array_normal_form", "SELECT raw.id AS id, array_to_string(list_sort(list_distinct(list_filter(list_transform(raw.location.area, lambda x: lower(trim(x))), lambda x: x <> ''))), '|') AS areas FROM records_project_manager__scrum_master WHERE raw.location.area IS NOT NULL")
def array_normal_form(s, d):
    a = F.filter(F.transform("raw.location.area", lambda x: F.lower(F.trim(x))), lambda x: x != "")
    return table(s, d, "records_project_manager__scrum_master").filter("raw.location.area is not null").select(F.col("raw.id").alias("id"), F.array_join(F.array_sort(F.array_distinct(a)), "|").alias("areas"))


@q("array_membership", "SELECT p_partkey, list_has_any(string_split(p_name, ' '), ['red', 'small']) AS overlaps, list_contains(string_split(p_name, ' '), 'ring') AS ring FROM part")
def array_membership(s, d):
    w = F.split("p_name", " ")
    return table(s, d, "part").select("p_partkey", F.arrays_overlap(w, F.array(F.lit("red"), F.lit("small"))).alias("overlaps"), F.array_contains(w, "ring").alias("ring"))


@q("json_props", "SELECT event_id, cast(props ->> '$.k' AS INTEGER) AS k, '{\"t\":\"' || event_type || '\"}' AS packed FROM events")
def json_props(s, d):
    return table(s, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"), F.to_json(F.struct(F.col("event_type").alias("t"))).alias("packed"))


@q("literal_dict", """SELECT event_id, len(event_type)::INTEGER AS ug, CASE WHEN value > 5 THEN 1 END AS pg, event_type || chr(39) || 's' AS who FROM events""")
def literal_dict(s, d):
    """Python dict texts, one for each event, parsed back to their parts."""
    ug = F.array_join(F.transform(F.split("event_type", ""), lambda c: F.concat(F.lit("'"), c, F.lit("'"))), ", ")
    raw = F.concat(F.lit("{'ug': ["), ug, F.lit("], 'pg': "), F.when(F.col("value") > 5, F.lit("True")).otherwise(F.lit("None")), F.lit(", 'who': \""), F.col("event_type"), F.lit("'s\"}"))
    e = table(s, d, "events").select("event_id", text.python_literal(raw, "ug array<string>, pg boolean, who string").alias("x"))
    return e.select("event_id", F.size("x.ug").alias("ug"), F.when(F.col("x.pg"), 1).alias("pg"), "x.who")


@q("vector_products", "SELECT vec_id, list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) AS norm2 FROM embeddings")
def vector_products(s, d):
    e = F.transform("embedding", lambda x: x.cast("double"))
    return table(s, d, "embeddings").select("vec_id", F.aggregate(F.zip_with(e, e, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b).alias("norm2"))


@q("softmax", """WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT vec_id, max(x) AS m FROM e GROUP BY 1)
    SELECT vec_id, (i - 1)::INTEGER AS i, exp(x - m) / sum(exp(x - m)) OVER (PARTITION BY vec_id) AS p FROM e JOIN m USING (vec_id)""")
def softmax(s, d):
    e = F.transform("embedding", lambda x: x.cast("double"))
    v = table(s, d, "embeddings").select("vec_id", F.transform(e, lambda x: F.exp(x - F.array_max(e))).alias("z"))
    total = F.aggregate("z", F.lit(0.0), lambda a, b: a + b)
    return v.select("vec_id", F.posexplode(F.transform("z", lambda x: x / total)).alias("i", "p"))


@q("sequences", "SELECT i::INTEGER AS i, 10.0 * 2 ** i AS geometric FROM (SELECT unnest(range(0, 11)) AS i)")
def sequences(s, d):
    return s.range(1).select(F.explode(F.sequence(F.lit(0), F.lit(10))).alias("i")).select("i", (10.0 * F.pow(F.lit(2.0), "i")).alias("geometric"))


# deduplication

_ID_ORDER = "try_cast(collection.collected_at AS TIMESTAMPTZ) NULLS FIRST, collection.run_id, collection.page, collection.position, raw.title NULLS FIRST"


@q("id_dedup", f"""
    WITH r AS (SELECT collection.adzuna_id AS id, collection.run_id AS run, row_number() OVER (PARTITION BY collection.adzuna_id ORDER BY {_ID_ORDER}) AS r,
      count(*) OVER (PARTITION BY collection.adzuna_id) AS n FROM records_graphic_designer__visual_designer WHERE trim(collection.adzuna_id) <> ''),
    s AS (SELECT id, list_sort(list(DISTINCT run)) AS runs FROM r GROUP BY 1)
    SELECT r.id, r.run, r.n AS dup_count, array_to_string(list_filter(s.runs, lambda x: x <> r.run), ',') AS also FROM r JOIN s ON s.id = r.id WHERE r.r = 1""")
def id_dedup(s, d):
    c = F.col
    r = table(s, d, "records_graphic_designer__visual_designer").select(
        c("collection.adzuna_id").alias("id"), c("collection.run_id").alias("run"), instant(c("collection.collected_at")).alias("at"), c("collection.page").alias("page"), c("collection.position").alias("position"), c("raw.title").alias("title")
    )
    one = dedup.by_id(r, "id", [c("at").asc_nulls_first(), c("run"), c("page"), c("position"), c("title").asc_nulls_first()], "run")
    return one.select("id", "run", "dup_count", F.array_join("also_seen_in", ",").alias("also"))


@q("id_conflicts", """
    WITH g AS (SELECT collection.adzuna_id AS id, count(DISTINCT coalesce(raw.title, '~')) AS title, count(DISTINCT coalesce(raw.description, '~')) AS description FROM records_project_manager__scrum_master WHERE trim(collection.adzuna_id) <> '' GROUP BY 1)
    SELECT 'title' AS field, count(*) FILTER (title > 1) AS ids FROM g UNION ALL SELECT 'description', count(*) FILTER (description > 1) FROM g""")
def id_conflicts(s, d):
    r = table(s, d, "records_project_manager__scrum_master").select(F.col("collection.adzuna_id").alias("id"), "raw.title", "raw.description")
    return dedup.id_conflicts(r, "id", ["title", "description"])


@q("multiplicity", "SELECT least(n, 10)::INTEGER AS times, count(*) AS ids FROM (SELECT collection.adzuna_id AS id, count(*) AS n FROM records_project_manager__scrum_master WHERE trim(collection.adzuna_id) <> '' GROUP BY 1) GROUP BY 1")
def multiplicity(s, d):
    return dedup.multiplicity(table(s, d, "records_project_manager__scrum_master").select(F.col("collection.adzuna_id").alias("id")), "id")


@q("near_dedup")
def near_dedup(s, d):
    r = table(s, d, "records_graphic_designer__visual_designer").select(
        F.col("collection.adzuna_id").alias("id"), "raw.title", F.col("raw.company.display_name").alias("employer"), "raw.description", instant(F.col("raw.created")).alias("created")
    )
    r = r.groupBy("id").agg(F.min(F.struct("created", "title", "employer", "description")).alias("x")).select("id", "x.*")
    k = dedup.near_keys(r, "title", "employer", "description")
    return dedup.near_dedup(k, [F.col("created").desc_nulls_last(), dedup.numeric_id("id"), F.col("id")]).select("id", "near_key", "group_size")


@q("template_collisions")
def template_collisions(s, d):
    docs = table(s, d, "documents").select("doc_id", "role", "employer", "text")
    return dedup.collisions(dedup.near_keys(docs, "role", "employer", "text", 40))


@q("dedup_first_seen", """
    WITH x AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY role, title NULLS FIRST) AS i FROM (SELECT DISTINCT job_id, role, title FROM human_validation_template)),
    y AS (SELECT *, row_number() OVER (PARTITION BY i = 1, role, title ORDER BY job_id) AS k, first_value(job_id) OVER (PARTITION BY i = 1, role, title ORDER BY job_id) AS f FROM x)
    SELECT job_id, role, title, CASE WHEN i > 1 THEN 'id' WHEN k > 1 THEN 'near' END AS reason, CASE WHEN i > 1 THEN job_id WHEN k > 1 THEN f END AS kept_id FROM y""")
def dedup_first_seen(s, d):
    h = table(s, d, "human_validation_template").select("job_id", "role", "title").distinct()
    w = Window.partitionBy("job_id").orderBy("role", F.col("title").asc_nulls_first())
    x = h.withColumn("i", F.row_number().over(w))
    first = dedup.first_seen(x, "job_id", ["role", "title"], [F.col("job_id"), F.col("i")])
    return first.select("job_id", "role", "title", "reason", "kept_id")


@q("cap_flag", """SELECT job_id, role, cap::INTEGER AS cap, within_cap FROM (SELECT job_id, role, greatest(1, floor(0.05 * count(*) OVER (PARTITION BY role))) AS cap,
    employer IS NULL OR trim(employer) = '' OR row_number() OVER (PARTITION BY role, employer ORDER BY job_id) <= greatest(1, floor(0.05 * count(*) OVER (PARTITION BY role))) AS within_cap FROM employer_cap_exclusions)""")
def cap_flag(s, d):
    return dedup.cap_flag(table(s, d, "employer_cap_exclusions"), "role", "employer", 0.05, [F.col("job_id")]).select("job_id", "role", "cap", "within_cap")


@q("duplicated_rows", """SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 OR row_number() OVER (PARTITION BY employer, role, posted_at ORDER BY doc_id) > 1 AS duplicate FROM documents""")
def duplicated_rows(s, d):
    return dedup.duplicated(table(s, d, "documents"), [["text"], ["employer", "role", "posted_at"]], [F.col("doc_id")]).select("doc_id", "duplicate")


@q("distinct_long_texts", "SELECT min(doc_id) AS doc_id FROM documents WHERE length(text) >= 50 GROUP BY text")
def distinct_long_texts(s, d):
    return table(s, d, "documents").filter(F.length("text") >= 50).groupBy(F.sha2("text", 256)).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@q("merge_skips", """
    WITH e AS (SELECT DISTINCT job_id FROM human_validation_template WHERE role = 'Project Manager'), b AS (SELECT job_id, role, title, row_number() OVER (PARTITION BY job_id ORDER BY role, title) AS r FROM human_validation_template WHERE role <> 'Project Manager')
    SELECT coalesce(CASE WHEN b.job_id IS NULL OR trim(b.job_id) = '' THEN 'no_id' WHEN e.job_id IS NOT NULL THEN 'in_existing' WHEN r > 1 THEN 'in_batch' WHEN title IS NULL THEN 'untitled' END, 'append') AS skip, count(*) AS n
    FROM b LEFT JOIN e ON e.job_id = b.job_id GROUP BY 1""")
def merge_skips(s, d):
    h = table(s, d, "human_validation_template")
    m = dedup.merge_new(h.filter("role = 'Project Manager'"), h.filter("role <> 'Project Manager'"), "job_id", [F.col("role"), F.col("title")], [("untitled", F.col("title").isNotNull())])
    return m.groupBy(F.coalesce("skip", F.lit("append")).alias("skip")).agg(F.count(F.lit(1)).alias("n"))


@q("run_self_audit", """SELECT collection.run_id AS run_id, count(*) - count(DISTINCT collection.adzuna_id) AS repeated, max(collection.page) AS pages, count(DISTINCT collection.page) AS seen FROM records_graphic_designer__visual_designer GROUP BY 1""")
def run_self_audit(s, d):
    c = F.col
    return table(s, d, "records_graphic_designer__visual_designer").groupBy(c("collection.run_id").alias("run_id")).agg(
        (F.count(F.lit(1)) - F.countDistinct("collection.adzuna_id")).alias("repeated"), F.max("collection.page").alias("pages"), F.countDistinct("collection.page").alias("seen")
    )


# quality

@q("conservation", """SELECT count(*) AS rows_in, count(*) FILTER (collection.adzuna_id IS NULL) AS no_id, count(*) FILTER (collection.adzuna_id IS NOT NULL) - count(DISTINCT collection.adzuna_id) AS repeated,
    count(DISTINCT collection.adzuna_id) AS kept, true AS holds FROM records_project_manager__scrum_master""")
def conservation(s, d):
    a = table(s, d, "records_project_manager__scrum_master").select(F.col("collection.adzuna_id").alias("id")).agg(
        F.count(F.lit(1)).alias("rows_in"), F.count_if(F.col("id").isNull()).alias("no_id"), F.count("id").alias("with_id"), F.countDistinct("id").alias("kept")
    )
    repeated = F.col("with_id") - F.col("kept")
    return a.select("rows_in", "no_id", repeated.alias("repeated"), "kept", (F.col("rows_in") == F.col("no_id") + repeated + F.col("kept")).alias("holds"))


@q("target_gates", """
    WITH n AS (SELECT role, employer, count(*) AS n FROM employer_cap_exclusions GROUP BY 1, 2), g AS (SELECT role, sum(n) AS n, count(employer) AS employers, max(n) FILTER (employer IS NOT NULL) / sum(n) AS top FROM n GROUP BY 1)
    SELECT role, n, array_to_string(list_filter([CASE WHEN n < 100 THEN 'rows' END, CASE WHEN employers < 20 THEN 'employers' END, CASE WHEN top > 0.1 THEN 'top' END], lambda x: x IS NOT NULL), ',') AS failed FROM g""")
def target_gates(s, d):
    n = table(s, d, "employer_cap_exclusions").groupBy("role", "employer").agg(F.count(F.lit(1)).alias("n"))
    g = n.groupBy("role").agg(F.sum("n").alias("n"), F.count("employer").alias("employers"), (F.max(F.when(F.col("employer").isNotNull(), F.col("n"))) / F.sum("n")).alias("top"))
    failed = F.array_compact(F.array(F.when(F.col("n") < 100, "rows"), F.when(F.col("employers") < 20, "employers"), F.when(F.col("top") > 0.1, "top")))
    return g.select("role", "n", F.array_join(failed, ",").alias("failed"))


@q("cap_consistency", """SELECT role, count(*) FILTER (rank_within_employer_most_recent_first IS NOT NULL AND rank_within_employer_most_recent_first <> r) AS mismatches FROM
    (SELECT *, row_number() OVER (PARTITION BY role, employer ORDER BY try_cast(nullif(trim(created), '') AS TIMESTAMPTZ) DESC NULLS LAST, job_id) AS r FROM employer_cap_exclusions) GROUP BY 1""")
def cap_consistency(s, d):
    r = F.row_number().over(Window.partitionBy("role", "employer").orderBy(instant(F.col("created")).desc_nulls_last(), "job_id"))
    old = F.col("rank_within_employer_most_recent_first")
    return table(s, d, "employer_cap_exclusions").withColumn("r", r).groupBy("role").agg(F.count_if(old.isNotNull() & (old != F.col("r"))).alias("mismatches"))


@q("leakage_families", f"""
    WITH f AS (SELECT {_NORM.format('raw.company.display_name')} AS e, {_NORM.format('raw.title')} AS t, count(DISTINCT collection.adzuna_id) AS n FROM records_graphic_designer__visual_designer GROUP BY 1, 2)
    SELECT count(*) AS families, count(*) FILTER (n > 1) AS repeated, sum(n) FILTER (n > 1) AS ids FROM f""")
def leakage_families(s, d):
    r = table(s, d, "records_graphic_designer__visual_designer").select(text.norm_text(F.col("raw.company.display_name")).alias("e"), text.norm_text(F.col("raw.title")).alias("t"), F.col("collection.adzuna_id").alias("id"))
    f = r.groupBy("e", "t").agg(F.countDistinct("id").alias("n"))
    return f.agg(F.count(F.lit(1)).alias("families"), F.count_if(F.col("n") > 1).alias("repeated"), F.sum(F.when(F.col("n") > 1, F.col("n"))).alias("ids"))
