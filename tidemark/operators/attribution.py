"""Attribution joins: effect sites to their innermost range, gate language to the operations it names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import identity_tokens

# Words of an operation's name that show which gate is its own.
GATE_NAME_HINTS = {
    "publish": ("publish", "upload", "release", "post", "deploy", "ship"),
    "spend": ("spend", "charge", "pay", "bill", "purchase", "invoice"),
    "irreversible": ("delete", "wipe", "purge", "drop", "migrate", "destroy"),
    "legal": ("license", "licence", "rights", "copyright", "legal", "provenance", "consent", "attribution", "disclosure", "terms"),
    "privacy": ("privacy", "personal", "pii", "gdpr", "redact", "anonymize", "anonymise", "scrub"),
}


def claim_innermost(sites: DataFrame, ranges: DataFrame, keys: list[str], at: str, lo: str, hi: str, site_id: str, range_order: str) -> DataFrame:
    """Each site with the smallest range of its keys that holds it; ties go to the first range in order.

    An equi-join on the keys with the containment as residual condition; the choice of the innermost is an aggregate
    (a struct minimum), so it combines on the map side and needs no sort of a site's candidates.
    """
    held = sites.join(ranges, keys).where(F.col(at).between(F.col(lo), F.col(hi)))
    rest = [c for c in ranges.columns if c not in keys]
    best = F.min(F.struct((F.col(hi) - F.col(lo)).alias("_width"), F.col(range_order).alias("_order"), *[F.col(c).alias(f"r_{c}") for c in rest])).alias("_best")
    return held.groupBy(*sites.columns).agg(best).select(*sites.columns, *[F.col(f"_best.r_{c}").alias(c) for c in rest])


def claim_leftovers(sites: DataFrame, ranges: DataFrame, rangeless: DataFrame, keys: list[str], at: str, lo: str, hi: str, owner: str) -> DataFrame:
    """Sites in no range: claimed weakly by the only rangeless candidate of their keys, unattributed where there are several.

    Sites whose keys have no rangeless candidate are left out, as nothing could own them.
    """
    inside = (F.col(f"s.{at}") >= F.col(f"r.{lo}")) & (F.col(f"s.{at}") <= F.col(f"r.{hi}"))
    same = [F.col(f"s.{k}") == F.col(f"r.{k}") for k in keys]
    free = sites.alias("s").join(ranges.alias("r"), [*same, inside], "left_anti")
    owners = rangeless.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(owner).alias("_only"))
    return free.join(owners, keys).select(*sites.columns, F.when(F.col("_n") == 1, F.col("_only")).alias(owner), (F.col("_n") == 1).alias("weak"))


def as_of(rows: DataFrame, keys: list[str], order: str, value, strict: bool = False) -> DataFrame:
    """Nearest previous non-null ``value`` (with the row itself unless ``strict``) as column ``as_of``."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    return rows.withColumn("as_of", F.last(value, ignorenulls=True).over(w))


def associate_gates(signals: DataFrame, operations: DataFrame, line: str, order: list[str], scope: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Gate signals with the operations that own them, and the signals that name no operation.

    An operation is named by a line with a word that begins with one of its identity tokens. Owners are the named
    operations whose name hints at the gate, or else all named ones; each operation and gate keeps its first signal. (A limit of
    six signals an operation, as a report may set, can't bind: there are five gates.)
    Lines are cut into word beginnings of the tokens' lengths, which turns the prefix match into an equi-join. ``scope``
    (a repository, say) is shared by signals and operations; ``order`` names a signal within it.
    """
    at = [*scope, *order]
    tokens = operations.select(*scope, "op_id", F.explode(identity_tokens(F.col("name"))).alias("token")).withColumn("n", F.length("token"))
    lengths = F.broadcast(tokens.select("n").distinct())  # word lengths: a few dozen rows at most
    words = signals.select(*at, "gate", F.explode(F.array_distinct(F.split(F.lower(line), r"\W+"))).alias("word")).where("word <> ''")
    heads = words.join(lengths, F.length("word") >= F.col("n")).select(*at, "gate", F.substring("word", F.lit(1), F.col("n")).alias("token")).distinct()
    named = heads.join(tokens.select(*scope, "op_id", "token"), [*scope, "token"]).select(*at, "gate", "op_id").distinct()
    hints = F.array(*[F.struct(F.lit(g).alias("gate"), F.lit(h).alias("hint")) for g, hs in GATE_NAME_HINTS.items() for h in hs])
    prefixed = F.col("token").startswith(F.col("x.hint")) | F.col("x.hint").startswith(F.col("token"))
    fit = tokens.select(*scope, "op_id", "token", F.explode(hints).alias("x")).where(prefixed).select(*scope, "op_id", "x.gate", F.lit(1).alias("fits")).distinct()
    scored = named.join(fit, [*scope, "op_id", "gate"], "left").withColumn("fits", F.coalesce("fits", F.lit(0)))
    best = scored.groupBy(*at, "gate").agg(F.max("fits").alias("best"))
    owned = scored.join(best, [*at, "gate"]).where("fits = best")
    first = owned.groupBy(*scope, "op_id", "gate").agg(F.min(F.struct(*order)).alias("x")).select(*scope, "op_id", "gate", *[F.col(f"x.{c}") for c in order])
    return first, signals.join(named.select(*at, "gate").distinct(), [*at, "gate"], "left_anti")
