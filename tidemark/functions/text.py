"""Text functions as Column expressions: no UDF, so they stay inside generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Credential shapes, each replaced in this order.
SECRET_PATTERNS = [
    r"\b(sk|pk|rk)-[A-Za-z0-9_\-]{16,}",
    r"\bsk_live_[A-Za-z0-9]{16,}",
    r"\bAKIA[0-9A-Z]{16}\b",
    r"\bgh[pousr]_[A-Za-z0-9]{20,}",
    r"\bxox[baprs]-[A-Za-z0-9\-]{10,}",
    r"\bAIza[0-9A-Za-z_\-]{30,}",
    r"\beyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}",
    r"(?i)\b(bearer|token|secret|password|passwd|api[_-]?key)\b\s*[:=]\s*\S{8,}",
]
# Kinds of credentials that a scan names, and what stands in for one in examples.
SECRET_KINDS = {
    "openai": r"\bsk-[A-Za-z0-9_\-]{16,}",
    "stripe": r"\b[spr]k_live_[A-Za-z0-9]{16,}",
    "aws": r"\bAKIA[0-9A-Z]{16}\b",
    "github": r"\bgh[pousr]_[A-Za-z0-9]{20,}",
    "slack": r"\bxox[baprs]-[A-Za-z0-9\-]{10,}",
    "google": r"\bAIza[0-9A-Za-z_\-]{30,}",
    "sendgrid": r"\bSG\.[A-Za-z0-9_\-]{16,}\.[A-Za-z0-9_\-]{16,}",
    "twilio": r"\b(?:AC|SK)[0-9a-f]{32}\b",
    "jwt": r"\beyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}",
    "pem": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "assignment": r"(?i)\b(bearer|token|secret|password|passwd|api[_-]?key)\b\s*[:=]\s*\S{8,}",
}
PLACEHOLDER = r"(?i)\$\{[^}]*\}|os\.environ|your-[a-z0-9-]*-here|<[a-z_-]+>"
# Language that points to a gate, and to an optional step.
GATE_LANGUAGE = {
    "publish": r"\b(?:publish(?:es|ing)?|upload(?:s|ing)?|go(?:es)? live|release(?:s|d)? to|post(?:s|ing)? publicly|make public|ship(?:s|ping)? to production)\b",
    "spend": r"\b(?:costs?|bill(?:ing|ed)?|paid (?:tier|plan|api)|charges?|credits?|budget|pricing|per[- ](?:call|request|token|image|minute))\b|\$",
    "irreversible": r"\b(?:cannot be undone|irreversible|permanent(?:ly)?|destructive|delete permanently|wipe[sd]?|hard delete|migrat(?:e|ion))\b",
    "legal": r"\b(?:rights?|licen[cs]e|copyright|provenance|disclos(?:e|ure)|consent|attribution|synthetic media|fair use|terms of service)\b",
    "privacy": r"\b(?:privacy|personal data|PII|GDPR|visibility|private by default|default_privacy|sensitive)\b",
}
OPTIONAL_LANGUAGE = r"\b(?:optional(?:ly)?|if (?:you )?(?:want|wish)|can be skipped|nice to have|not required)\b"
#: What a lower-cased text must hold, one of each list, for a pattern to match at all. A plain substring test runs at the
#: speed of memory, a regular expression of many words doesn't; so most texts never meet the expression.
GATE_WORDS = {
    "publish": ("publish", "upload", "live", "release", "public", "production"),
    "spend": ("cost", "bill", "paid ", "charge", "credit", "budget", "pricing", "per-", "per ", "$"),
    "irreversible": ("undone", "irreversible", "permanent", "destructive", "wipe", "hard delete", "migrat"),
    "legal": ("right", "licen", "provenance", "disclos", "consent", "attribution", "synthetic media", "fair use", "terms of"),
    "privacy": ("privacy", "personal data", "pii", "gdpr", "visibility", "private by", "sensitive"),
}
OPTIONAL_WORDS = ("optional", "if ", "skipped", "nice to", "not required")
GH, ASSIGNED = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), ("bearer", "token", "secret", "passw", "apikey", "api_key", "api-key")
SECRET_WORDS = [("sk-", "pk-", "rk-"), ("sk_live_",), ("akia",), GH, ("xox",), ("aiza",), ("eyj",), ASSIGNED]
KIND_WORDS = {
    "openai": ("sk-",), "stripe": ("k_live_",), "aws": ("akia",), "github": GH, "slack": ("xox",), "google": ("aiza",), "sendgrid": ("sg.",), "twilio": ("ac", "sk"), "jwt": ("eyj",), "pem": ("-----begin",),
    "assignment": ASSIGNED,
}
CLAIM_WORDS = {"study": ("stud", "research", "scientist", "expert"), "attribution": ("according",), "superlative": ("est", "most", "worst", "leading", "world"), "absolute": ("al", "never", "every", "no")}
# Markers of sentences that assert something checkable.
CLAIM_MARKERS = {
    "statistic": r"(?i)\b\d+(?:\.\d+)?\s?(?:%|percent|per cent)\b",
    "quantity": r"\b\d[\d,]{2,}\b",
    "date": r"\b(?:19|20)\d{2}\b",
    "study": r"(?i)\b(?:studies|research|scientists|experts)\s+(?:show|shows|say|says|found|suggest)",
    "superlative": r"(?i)\b(?:best|fastest|largest|biggest|most|worst|leading|world[- ]class)\b",
    "absolute": r"(?i)\b(?:always|never|everyone|nobody|all|none)\b",
    "attribution": r"(?i)\baccording to\b",
}
# Words that carry no operation identity.
STOPWORDS = (
    "command commands with from that this into each then your have will when also only over more than them they there "
    "their which using used operation operations"
).split()
# Verbs of each phase, in the order in which phases are tried.
PHASE_VERBS = {
    "acquire": "fetch read get load download collect ingest import pull sync scrape crawl receive query search list discover resolve scan",
    "prepare": (
        "init setup configure config install provision bootstrap migrate seed auth login connect mount clone plan compile build "
        "bundle parse normalize normalise clean preprocess chunk embed index"
    ),
    "transform": (
        "generate create write compose render transform convert translate summarize summarise extract classify analyze analyse "
        "process compute calculate merge split edit modify update enrich annotate assemble encode train"
    ),
    "verify": "validate verify check test lint audit review inspect assert approve confirm sanitize sanitise compare diff score grade moderate",
    "deliver": "publish upload deploy release send post submit push deliver ship notify email sms announce export emit charge bill pay transfer",
    "observe": "monitor report log track metric metrics analytics stats statistics status health watch alert dashboard record usage",
}


def holds(low: Column, words: tuple[str, ...]) -> Column:
    """A lower-cased text holds one of the words."""
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])


def slugify(text: Column) -> Column:
    """Lower-case kebab case: runs of characters that are no letters or digits become one dash, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "-"), F.lit("-"))


def redact(text: Column, low: Column | None = None) -> Column:
    """Replace credential shapes, one pattern after the other.

    Here and below ``low`` is the lower-cased text as a column of its own, so that it is made once for all tests.
    """
    low = F.lower(text) if low is None else low
    some = holds(low, tuple(w for words in SECRET_WORDS for w in words))
    return F.when(some, reduce(lambda t, p: F.regexp_replace(t, p, "[redacted]"), SECRET_PATTERNS, text)).otherwise(text)


def contains_secret(text: Column, low: Column | None = None) -> Column:
    low = F.lower(text) if low is None else low
    return reduce(lambda a, b: a | b, [holds(low, w) & text.rlike(p) for p, w in zip(SECRET_PATTERNS, SECRET_WORDS, strict=True)])


def secret_kinds(line: Column, low: Column | None = None) -> Column:
    """Kinds of credentials on a line, sorted; lines that show a placeholder have none. Never the value itself."""
    low = F.lower(line) if low is None else low
    kinds = F.array_compact(F.array(*[F.when(holds(low, KIND_WORDS[k]) & line.rlike(p), F.lit(k)) for k, p in SECRET_KINDS.items()]))
    return F.when((F.size(kinds) > 0) & line.rlike(PLACEHOLDER), F.array().cast("array<string>")).otherwise(F.array_sort(kinds))


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def gates_of(line: Column, low: Column | None = None) -> Column:
    """Gates whose language a line uses, one signal for each."""
    low = F.lower(line) if low is None else low
    return F.array_compact(F.array(*[F.when(holds(low, GATE_WORDS[g]) & line.rlike("(?i)" + p), F.lit(g)) for g, p in GATE_LANGUAGE.items()]))


def is_optional(line: Column, low: Column | None = None) -> Column:
    return holds(F.lower(line) if low is None else low, OPTIONAL_WORDS) & line.rlike("(?i)" + OPTIONAL_LANGUAGE)


def sentences(text: Column) -> Column:
    """Split after . ! or ? at whitespace; trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def claim_reasons(sentence: Column, low: Column | None = None) -> Column:
    """Names of the markers a sentence carries, sorted."""
    low = F.lower(sentence) if low is None else low
    digits = sentence.rlike("[0-9]")
    test = lambda k, p: (holds(low, CLAIM_WORDS[k]) if k in CLAIM_WORDS else digits) & sentence.rlike(p)
    return F.array_sort(F.array_compact(F.array(*[F.when(test(k, p), F.lit(k)) for k, p in CLAIM_MARKERS.items()])))


def humanize(name: Column) -> Column:
    t = F.trim(F.translate(name, "-_", "  "))
    return F.when(F.coalesce(t, F.lit("")) == "", "Operation").otherwise(F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substring(t, 2, 1 << 30))))


def split_camel(name: Column) -> Column:
    return F.regexp_replace(name, "(?<=[a-z0-9])(?=[A-Z])", " ")


def phase_words(name: Column) -> Column:
    """Tokens of over two characters, and their singular where they have over four."""
    tokens = F.filter(F.split(F.translate(F.lower(name), "-_", "  "), r"\s+"), lambda w: F.length(w) > 2)
    singular = F.transform(F.filter(tokens, lambda w: w.endswith("s") & (F.length(w) > 4)), lambda w: F.substring(w, F.lit(1), F.length(w) - 1))
    return F.array_union(tokens, singular)


def infer_phase(name: Column, effect: Column, requires: Column, gates: Column) -> Column:
    """The first phase with a verb among the name's words; else by gate; else by effect."""
    words = phase_words(name)
    out = reduce(
        lambda c, p: c.when(F.arrays_overlap(words, F.array(*map(F.lit, PHASE_VERBS[p].split()))), p),
        list(PHASE_VERBS)[1:],
        F.when(F.arrays_overlap(words, F.array(*map(F.lit, PHASE_VERBS["acquire"].split()))), "acquire"),
    )
    out = out.when(F.array_contains(gates, "publish"), "deliver").when(F.array_contains(gates, "spend") & F.array_contains(requires, "payment.charge"), "deliver")
    return out.when(effect.isin("read-local", "read-external"), "acquire").when(effect == "effectful-external", "deliver").otherwise("transform")


def identity_tokens(name: Column) -> Column:
    """Words of over three characters that can identify an operation."""
    tokens = F.filter(F.split(F.lower(F.coalesce(name, F.lit(""))), r"\W+"), lambda w: F.length(w) > 3)
    return F.array_sort(F.array_except(tokens, F.array(*map(F.lit, STOPWORDS))))


def requirement_name(line: Column) -> Column:
    """The package of a requirements line: comment and options dropped, lower case, dashes; null where there is none."""
    bare = F.trim(F.regexp_replace(line, r"\s*#.*$", ""))
    name = F.regexp_extract(bare, r"^([A-Za-z0-9][A-Za-z0-9._-]*)", 1)
    return F.when(bare.startswith("-") | (name == ""), None).otherwise(F.translate(F.lower(name), "_", "-"))


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("long")


def line_of(text: Column, offset: Column) -> Column:
    """1-based line of a 0-based offset."""
    before = F.substring(text, F.lit(1), offset)
    return (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("int")


def join_path(base: Column, path: Column) -> Column:
    joined = F.concat(F.rtrim(F.coalesce(base, F.lit("")), F.lit("/")), F.lit("/"), F.ltrim(F.coalesce(path, F.lit("")), F.lit("/")))
    return F.when(joined == "/", joined).otherwise(F.rtrim(joined, F.lit("/")))


def srt_timestamp(ms: Column) -> Column:
    """HH:MM:SS,mmm of whole milliseconds."""
    part = lambda d, m: F.floor(ms / d) % m
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3600000), part(60000, 60), part(1000, 60), ms % 1000)


def srt_seconds(seconds: Column) -> Column:
    """HH:MM:SS,mmm of seconds, rounded to milliseconds half to even."""
    return srt_timestamp(F.bround(seconds * 1000).cast("long"))


def wrap(text: Column, limit: int) -> Column:
    """Lines of at most ``limit`` characters, filled word by word; a longer word has a line of its own."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("line"))

    def step(acc: Column, word: Column) -> Column:
        longer = F.when(acc["line"] == "", word).otherwise(F.concat_ws(" ", acc["line"], word))
        full = (acc["line"] != "") & (F.length(longer) > limit)
        return F.struct(F.when(full, F.array_append(acc["done"], acc["line"])).otherwise(acc["done"]).alias("done"), F.when(full, word).otherwise(longer).alias("line"))

    return F.aggregate(words, start, step, lambda acc: F.when(acc["line"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["line"])))


def clip(text: Column, most: int = 4000) -> Column:
    """Credentials redacted, then cut to ``most`` characters with a note of how many are missing; null is empty."""
    clean = redact(text)
    note = F.concat(F.left(clean, F.lit(most)), F.lit("\n[... "), F.length(clean) - most, F.lit(" chars truncated]"))
    return F.when(text.isNull(), "").otherwise(F.when(F.length(clean) > most, note).otherwise(clean))


def tool_names(json: Column) -> Column:
    """Distinct sorted names of the tools of a JSON manifest: its ``tools``, or the list that it is."""
    listed = F.coalesce(F.get_json_object(json, "$.tools"), F.when(json.rlike(r"^\s*\["), json))
    names = F.transform(F.from_json(listed, "array<struct<name:string>>"), lambda t: F.trim(t["name"]))
    return F.array_sort(F.array_distinct(F.filter(names, lambda n: n != "")))


def with_note(notes: Column, note: Column) -> Column:
    """Notes with one more at the end, parted by '; '."""
    return F.concat_ws("; ", F.when(notes != "", notes), note)


def coerced(value: Column, kind: Column) -> Column:
    """A JSON value as its declared kind: the text of a string, a number as a double's text, a whole number; null where it is none.

    true and false are no numbers; values of undeclared kinds pass as they are.
    """
    from tidemark.operators.checks import is_kind

    fits = is_kind(value, kind)
    parsed = F.try_parse_json(value)
    return (
        F.when(~kind.isin("string", "number", "integer") | kind.isNull(), value).when(~fits, None).when(kind == "string", F.try_variant_get(parsed, "$", "string"))
        .when(kind == "number", F.try_variant_get(parsed, "$", "double").cast("string")).otherwise(F.try_variant_get(parsed, "$", "bigint").cast("string"))
    )


def skill_name(url: Column, profile: Column) -> Column:
    """Name of a package: stem of the address (40 characters at most), then the profile (16), 64 in all."""
    stem = F.regexp_replace(F.substring_index(F.rtrim(url, F.lit("/")), "/", -1), r"\.git$", "")
    head, tail = F.left(slugify(stem), F.lit(40)), F.left(slugify(profile), F.lit(16))
    return F.trim(F.left(F.concat_ws("-", F.trim(head, F.lit("-")), F.trim(tail, F.lit("-"))), F.lit(64)), F.lit("-"))
