"""Queries of the text functions over documents, pages, conversations and part, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import selection
from tidemark.sources.tables import read, read_texts

joined = lambda a: F.concat_ws(",", a)


def fn_slugify(spark: SparkSession, sf: str) -> DataFrame:
    title = F.regexp_extract("html", r"<title>([^<]*)</title>", 1)
    return read(spark, sf, "pages").select("page_id", T.slugify(title).alias("slug"), T.skill_name(F.col("url"), F.lit("bare")).alias("package"))


def fn_redact(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_texts(spark, sf, "documents").select("doc_id", "text", F.lower("text").alias("low"))
    return docs.select("doc_id", F.sha2(T.redact(F.col("text"), F.col("low")), 256).alias("redacted_sha256"), T.contains_secret(F.col("text"), F.col("low")).alias("has_secret"))


def line_rows(spark: SparkSession, sf: str) -> DataFrame:
    return read_texts(spark, sf, "documents").select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("i", "line")).select("doc_id", "line", (F.col("i") + 1).cast("long").alias("line_no"), F.lower("line").alias("low"))


def fn_scan_secret(spark: SparkSession, sf: str) -> DataFrame:
    return line_rows(spark, sf).select("doc_id", "line_no", F.explode(T.secret_kinds(F.col("line"), F.col("low"))).alias("kind"))


def fn_gate_language(spark: SparkSession, sf: str) -> DataFrame:
    return line_rows(spark, sf).select("doc_id", "line_no", F.explode(T.gates_of(F.col("line"), F.col("low"))).alias("gate"))


def fn_optional_language(spark: SparkSession, sf: str) -> DataFrame:
    return line_rows(spark, sf).groupBy("doc_id").agg(F.count_if(T.is_optional(F.col("line"), F.col("low"))).alias("n_optional"))


def sentence_rows(spark: SparkSession, sf: str) -> DataFrame:
    return read_texts(spark, sf, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("i", "sentence")).withColumn("sentence_no", (F.col("i") + 1).cast("long"))


def fn_sentence_split(spark: SparkSession, sf: str) -> DataFrame:
    s = T.sentences(F.col("text"))
    return read_texts(spark, sf, "documents").select("doc_id", F.size(s).cast("long").alias("n_sentences"), F.md5(F.concat_ws("|", s)).alias("sentences_md5"))


def fn_flag_claims(spark: SparkSession, sf: str) -> DataFrame:
    rows = sentence_rows(spark, sf).withColumn("low", F.lower("sentence"))
    rows = rows.select("doc_id", "sentence_no", joined(T.claim_reasons(F.col("sentence"), F.col("low"))).alias("reasons"))
    return rows.where("reasons <> ''")


def win_cue_cursor(spark: SparkSession, sf: str) -> DataFrame:
    """Subtitle cues in milliseconds: each at least 4 s and a second for each 18 characters; starts add up in a document."""
    rows = selection.cues(sentence_rows(spark, sf), ["doc_id"], "sentence_no", "sentence")
    return rows.select("doc_id", "sentence_no", "start_ms", T.srt_timestamp(F.col("start_ms")).alias("starts"), T.srt_timestamp(F.col("start_ms") + F.col("span_ms")).alias("ends"))


def fn_phase_infer(spark: SparkSession, sf: str) -> DataFrame:
    effect = F.element_at(F.array(*map(F.lit, ("read-local", "read-external", "effectful-local", "effectful-external"))), (F.col("p_size") % 4 + 1).cast("int"))
    verb = F.element_at(F.array(*map(F.lit, ("", "fetch", "build", "renders", "check", "publish", "stats"))), (F.col("p_partkey") % 7 + 1).cast("int"))
    name = F.concat_ws("-", verb, F.translate("p_name", " ", "_"))
    gates = F.when(F.col("p_partkey") % 11 == 0, F.array(F.lit("publish"))).otherwise(F.array().cast("array<string>"))
    rows = read(spark, sf, "part").select("p_partkey", name.alias("name"), effect.alias("effect"), gates.alias("gates"))
    return rows.select(
        "p_partkey", T.infer_phase(F.col("name"), F.col("effect"), F.array(F.lit("data.query")), F.col("gates")).alias("phase"),
        joined(F.array_sort(T.phase_words(F.col("name")))).alias("words"), T.humanize(F.col("name")).alias("title"),
    )


def fn_identity_tokens(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_texts(spark, sf, "conversations").select("conv_id", "turn", T.identity_tokens(F.col("text")).alias("t"))
    return rows.select("conv_id", "turn", F.size("t").cast("long").alias("n_tokens"), F.md5(joined(F.col("t"))).alias("tokens_md5"))


def fn_token_estimate(spark: SparkSession, sf: str) -> DataFrame:
    found = F.locate("e", F.col("text")) - 1
    return read_texts(spark, sf, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"), T.line_of(F.col("text"), F.greatest(found, F.lit(0))).cast("long").alias("line_of_e"))


def jn_gate_assoc(spark: SparkSession, sf: str) -> DataFrame:
    from tidemark.operators.attribution import associate_gates

    signals = fn_gate_lines(spark, sf)
    ops = read(spark, sf, "nation").select(F.concat(F.lit("op-"), F.col("n_nationkey")).alias("op_id"), F.concat_ws(" ", F.lower("n_name"), F.element_at(F.array(*map(F.lit, ("license", "version", "released", "reserved", "public"))), (F.col("n_nationkey") % 5 + 1).cast("int"))).alias("name"))
    owned, unowned = associate_gates(signals, ops, line="line", order=["doc_id", "line_no"])
    mine = owned.select("op_id", "gate", "doc_id", "line_no")
    return mine.unionByName(unowned.groupBy("gate").agg(F.count("*").alias("line_no")).select(F.lit("unattributed").alias("op_id"), "gate", F.lit(-1).cast("long").alias("doc_id"), "line_no"))


def fn_gate_lines(spark: SparkSession, sf: str) -> DataFrame:
    return line_rows(spark, sf).select("doc_id", "line_no", "line", F.explode(T.gates_of(F.col("line"), F.col("low"))).alias("gate"))


def rx(p: str) -> str:
    return p.replace("'", "''")


def word_list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def sql() -> dict[str, str]:
    redacted = "text"
    for p in T.SECRET_PATTERNS:
        redacted = f"regexp_replace({redacted}, '{rx(p)}', '[redacted]', 'g')"
    has = " OR ".join(f"regexp_matches(text, '{rx(p)}')" for p in T.SECRET_PATTERNS)
    lines = "lines AS (SELECT doc_id, CAST(i AS BIGINT) AS line_no, l[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), LATERAL unnest(generate_series(1, len(l))) AS t(i))"
    sents = r"""sents AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[\t\n\v\f\r ]+', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '') AS s FROM documents)"""
    rows = "srows AS (SELECT doc_id, CAST(i AS BIGINT) AS sentence_no, s[i] AS sentence FROM sents, LATERAL unnest(generate_series(1, len(s))) AS t(i))"
    reasons = "array_to_string(list_sort(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(regexp_replace(sentence, '[^\\x00-\\x7F]', 'q', 'g'), '{rx(p)}') THEN '{k}' END" for k, p in T.CLAIM_MARKERS.items()) + "], lambda x: x IS NOT NULL)), ',')"
    kinds = " UNION ALL ".join(f"SELECT doc_id, line_no, '{k}' AS kind FROM lines WHERE regexp_matches(line, '{rx(p)}') AND NOT regexp_matches(line, '{rx(T.PLACEHOLDER)}')" for k, p in T.SECRET_KINDS.items())
    gates = " UNION ALL ".join(f"SELECT doc_id, line_no, '{g}' AS gate FROM lines WHERE regexp_matches(line, '(?i){rx(p)}')" for g, p in T.GATE_LANGUAGE.items())
    gate_lines = " UNION ALL ".join(f"SELECT doc_id, line_no, line, '{g}' AS gate FROM lines WHERE regexp_matches(line, '(?i){rx(p)}')" for g, p in T.GATE_LANGUAGE.items())
    slug = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', '-', 'g'), '-')"
    stamp = "printf('%02d:%02d:%02d,%03d', {0} // 3600000, ({0} // 60000) % 60, ({0} // 1000) % 60, {0} % 1000)"
    verbs = " ".join(f"WHEN list_has_any(words, {word_list(v.split())}) THEN '{p}'" for p, v in T.PHASE_VERBS.items())
    # RE2 takes only ASCII letters as word characters at a boundary, so others become one.
    from tidemark.operators.attribution import GATE_NAME_HINTS

    hints = ", ".join(f"('{g}', '{h}')" for g, hs in GATE_NAME_HINTS.items() for h in hs)
    return {
        "fn_slugify": f"SELECT page_id, {slug.format(chr(39).join(['regexp_extract(html, ', '<title>([^<]*)</title>', ', 1)']))} AS slug, trim(left(trim(left({slug.format(chr(39).join(['regexp_replace(regexp_extract(rtrim(url, ', '/', '), ', '([^/]*)$', ', 1), ', '[.]git$', ', ', '', ')']))}, 40), '-') || '-bare', 64), '-') AS package FROM pages",
        "fn_redact": f"SELECT doc_id, sha256({redacted}) AS redacted_sha256, ({has}) AS has_secret FROM documents",
        "fn_scan_secret": f"WITH {lines} {kinds}",
        "fn_gate_language": f"WITH {lines} {gates}",
        "fn_optional_language": f"WITH {lines} SELECT doc_id, count(*) FILTER (WHERE regexp_matches(line, '(?i){rx(T.OPTIONAL_LANGUAGE)}')) AS n_optional FROM lines GROUP BY doc_id",
        "fn_sentence_split": f"WITH {sents} SELECT doc_id, CAST(len(s) AS BIGINT) AS n_sentences, md5(array_to_string(s, '|')) AS sentences_md5 FROM sents",
        "fn_flag_claims": f"WITH {sents}, {rows} SELECT doc_id, sentence_no, {reasons} AS reasons FROM srows WHERE {reasons} <> ''",
        "win_cue_cursor": f"WITH {sents}, {rows}, c AS (SELECT doc_id, sentence_no, CAST(greatest(4000, length(sentence) * 1000 // 18) AS BIGINT) AS span FROM srows), d AS (SELECT doc_id, sentence_no, span, CAST(coalesce(sum(span) OVER (PARTITION BY doc_id ORDER BY sentence_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms FROM c) SELECT doc_id, sentence_no, start_ms, {stamp.format('start_ms')} AS starts, {stamp.format('(start_ms + span)')} AS ends FROM d",
        "fn_phase_infer": f"""WITH n AS (SELECT p_partkey, ['', 'fetch', 'build', 'renders', 'check', 'publish', 'stats'][CAST(p_partkey % 7 + 1 AS INT)] || '-' || translate(p_name, ' ', '_') AS name,
 ['read-local', 'read-external', 'effectful-local', 'effectful-external'][p_size % 4 + 1] AS effect, p_partkey % 11 = 0 AS publish FROM part),
w AS (SELECT *, list_filter(regexp_split_to_array(translate(lower(name), '-_', '  '), '\\s+'), lambda x: length(x) > 2) AS t FROM n),
x AS (SELECT *, list_distinct(list_concat(t, list_transform(list_filter(t, lambda y: y LIKE '%s' AND length(y) > 4), lambda y: y[:-2]))) AS words FROM w)
SELECT p_partkey, CASE {verbs} WHEN publish THEN 'deliver' WHEN effect IN ('read-local', 'read-external') THEN 'acquire' WHEN effect = 'effectful-external' THEN 'deliver' ELSE 'transform' END AS phase,
 array_to_string(list_sort(words), ',') AS words, upper(left(trim(translate(name, '-_', '  ')), 1)) || lower(substr(trim(translate(name, '-_', '  ')), 2)) AS title FROM x""".replace("\\\\s", "\\s"),
        "fn_identity_tokens": f"""WITH t AS (SELECT conv_id, turn, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\W+'), lambda w: length(w) > 3 AND NOT list_contains({word_list(T.STOPWORDS)}, w)))) AS t FROM conversations)
SELECT conv_id, turn, CAST(len(t) AS BIGINT) AS n_tokens, md5(array_to_string(t, ',')) AS tokens_md5 FROM t""",
        "fn_token_estimate": "SELECT doc_id, CAST(length(text) // 4 AS BIGINT) AS tokens, CAST(1 + len(regexp_extract_all(left(text, greatest(instr(text, 'e') - 1, 0)), chr(10))) AS BIGINT) AS line_of_e FROM documents",
        "jn_gate_assoc": f"""WITH {lines}, g AS ({gate_lines}),
ops AS (SELECT 'op-' || n_nationkey AS op_id, lower(n_name) || ' ' || ['license', 'version', 'released', 'reserved', 'public'][n_nationkey % 5 + 1] AS name FROM nation),
tok AS (SELECT DISTINCT op_id, t FROM ops, LATERAL unnest(regexp_split_to_array(name, '\\W+')) AS u(t) WHERE length(t) > 3 AND NOT list_contains({word_list(T.STOPWORDS)}, t)),
hint(gate, h) AS (VALUES {hints}),
named AS (SELECT DISTINCT doc_id, line_no, gate, op_id FROM g JOIN tok ON regexp_matches(lower(line), '\\b' || t)),
fit AS (SELECT DISTINCT op_id, gate FROM tok JOIN hint ON starts_with(t, h) OR starts_with(h, t)),
own AS (SELECT n.*, f.op_id IS NOT NULL AS m, max(f.op_id IS NOT NULL) OVER (PARTITION BY doc_id, line_no, n.gate) AS anym FROM named n LEFT JOIN fit f ON f.op_id = n.op_id AND f.gate = n.gate),
one AS (SELECT op_id, gate, doc_id, line_no FROM own WHERE m = anym QUALIFY row_number() OVER (PARTITION BY op_id, gate ORDER BY doc_id, line_no) = 1)
SELECT * FROM one UNION ALL
SELECT 'unattributed', gate, -1, count(*) FROM g WHERE NOT EXISTS (SELECT 1 FROM named n WHERE n.doc_id = g.doc_id AND n.line_no = g.line_no AND n.gate = g.gate) GROUP BY gate""",
    }


QUERIES = {f.__name__: f for f in (fn_slugify, fn_redact, fn_scan_secret, fn_gate_language, fn_optional_language, fn_sentence_split, fn_flag_claims, win_cue_cursor, fn_phase_infer, fn_identity_tokens, fn_token_estimate, jn_gate_assoc)}
SQL = sql()
