"""Requests to the tools of a routed inventory, as a table or a stream of lines: one row of answer for each request that has one.

What a line asks, whether it may, and what is answered are expressions and a join on the tools; only the place of a request in
its session and whether the session has been opened need state. The same rows come out of a table and of a stream, however
often the stream is stopped and taken up again.

requests: session, place (order in the session), line        tools: name, description, payload (JSON), credentials (names)
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions.documents import canonical

# Codes of errors of the protocol.
UNREADABLE, INVALID, NO_METHOD, BAD_PARAMETERS = -32700, -32600, -32601, -32602
#: Of a session that calls a tool before it is opened, where that is asked for.
NOT_OPENED = -32002
#: Levels of nesting that a call's inputs may add to the answer's own three.
DEEPEST = 6
ANSWER = "session string, place long, number long, opened boolean, id string, code int, message string, result string, is_error boolean, text string"
SILENT = ("notifications/initialized", "initialized")


def tool_table(rows: DataFrame, standins: DataFrame, credentials: DataFrame | None = None) -> DataFrame:
    """Tools of resolved operations (of one profile) that run as stand-ins. credentials: id, credentials (array of name, kind, env)."""
    backed = rows.where("binding = 'script' and stand_in is not null").join(standins.select("stand_in", "desc", "caveat"), "stand_in", "left")
    none = F.array().cast("array<string>")
    if credentials is not None:
        backed = backed.join(credentials.select("id", F.filter(F.transform("credentials", lambda c: F.coalesce(c["env"], c["name"])), lambda x: x.isNotNull()).alias("names")), "id", "left")
    names = F.coalesce("names", none) if credentials is not None else none
    stand_in = F.struct(F.col("stand_in").alias("id"), "fidelity", F.col("desc").alias("does"), "caveat")
    payload = F.to_json(F.struct(F.col("id").alias("operation"), "binding", "stage", "effect", "requires", "gates", "deferred_gates", stand_in.alias("stand_in")))
    told = F.concat("id", F.lit(" ("), "stage", F.lit(", "), "effect", F.lit("): needs "), F.array_join("requires", ", "), F.lit("; replaced by "), "stand_in", F.coalesce(F.concat(F.lit(", "), "desc"), F.lit("")))
    return backed.select(F.col("id").alias("name"), told.alias("description"), payload.alias("payload"), names.alias("credentials"))


def listing(tools: DataFrame) -> DataFrame:
    """All tools by name as one document: the answer to a request for the list."""
    one = F.struct("name", "description", F.expr("named_struct('type', 'object')").alias("inputSchema"))
    return tools.agg(F.to_json(F.struct(F.array_sort(F.collect_list(one)).alias("tools"))).alias("listed"))


def called(payload: Column, missing: Column, inputs: Column) -> Column:
    """The text that a call is answered with. Scripts don't run here: the answer tells the plan, and which credentials lack."""
    more = F.to_json(F.struct(F.lit(False).alias("executed"), missing.alias("missing_env")))
    whole = F.concat(F.substring(payload, F.lit(1), F.length(payload) - 1), F.lit(","), F.substring(more, F.lit(2), F.length(more) - 2), F.lit(',"inputs":'), inputs, F.lit("}"))
    return canonical(F.try_parse_json(whole), DEEPEST)


def answered(requests: DataFrame, tools: DataFrame, present: tuple[str, ...] = ()) -> DataFrame:
    """What each line is answered with, wherever it stands: id (JSON), method, code and message of errors, text of calls, is_error.

    ``present`` are the credentials at hand. Empty lines and notifications have no answer (``silent``). Results are left to
    ``finished``, so that the list of all tools, which is long and always the same, is never shuffled.
    """
    v = F.try_parse_json(F.trim("line"))
    get = lambda path: F.try_variant_get("v", path, "variant")
    text = lambda path: F.when(F.schema_of_variant(get(path)) == "STRING", F.try_variant_get("v", path, "string"))
    rows = requests.withColumn("v", v).where(F.trim("line") != "")
    is_object = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    rows = rows.withColumns({"is_object": is_object, "method": F.when(is_object, text("$.method")), "id": F.when(is_object, F.to_json(get("$.id")))})
    rows = rows.withColumn("tool", F.when(F.col("method") == "tools/call", F.coalesce(text("$.params.name"), F.lit("null")))).withColumn("inputs", F.coalesce(F.to_json(get("$.params.arguments.inputs")), F.lit("{}")))
    known = tools.select(F.col("name").alias("tool"), "payload", "credentials", F.lit(True).alias("there"))
    rows = rows.join(known, "tool", "left")
    method, is_call = F.col("method"), F.col("method") == "tools/call"
    code = (
        F.when(F.col("v").isNull(), UNREADABLE).when(~F.col("is_object"), INVALID).when(is_call & F.col("there").isNull(), BAD_PARAMETERS)
        .when(method.isin("initialize", "ping", "tools/list", "tools/call", *SILENT), F.lit(None)).otherwise(NO_METHOD)
    )
    message = (
        F.when(F.col("code") == UNREADABLE, "parse error").when(F.col("code") == INVALID, "invalid request").when(F.col("code") == BAD_PARAMETERS, F.concat(F.lit("unknown tool: "), "tool"))
        .when(F.col("code") == NO_METHOD, F.concat(F.lit("method not found: "), F.coalesce(method, F.lit("null"))))
    )
    missing = F.array_except("credentials", F.array(*map(F.lit, present)).cast("array<string>"))
    told = F.when(is_call & F.col("there"), called(F.col("payload"), missing, F.col("inputs")))
    rows = rows.withColumn("code", code.cast("int")).withColumns({"message": message, "text": told, "is_error": F.coalesce(is_call & (F.size(missing) > 0), F.lit(False))})
    return rows.select(F.col("session").cast("string").alias("session"), F.col("place").cast("long").alias("place"), "method", "id", "code", "message", "text", "is_error", F.coalesce(method.isin(*SILENT), F.lit(False)).alias("silent"))


def refused(strict: bool) -> Column:
    """A call in a session that isn't open yet is refused, where that is asked for."""
    return F.lit(strict) & (F.col("method") == "tools/call") & ~F.col("opened") & F.col("code").isNull()


def finished(rows: DataFrame, tools: DataFrame, strict: bool) -> DataFrame:
    """Answers in the form of ANSWER, from rows with number and opened.

    The list of all tools is one value of one result, as the protocol has it, and as long as the tools are many. It is a subquery of
    ``result`` alone, so it isn't made for a reader who takes only the other columns: ``text`` has what calls are answered with.
    """
    method, no = F.col("method"), F.coalesce(refused(strict), F.lit(False))
    content = F.to_json(F.struct(F.array(F.struct(F.lit("text").alias("type"), "text")).alias("content")))
    result = (
        F.when(method == "initialize", '{"capabilities":{"tools":{"listChanged":false}}}').when(method == "ping", "{}").when(method == "tools/list", listing(tools).scalar())
        .when((method == "tools/call") & F.col("code").isNull() & ~no, content)
    )
    given = {"code": F.when(no, NOT_OPENED).otherwise(F.col("code")).cast("int"), "message": F.when(no, "the session isn't open").otherwise(F.col("message")), "result": result, "is_error": F.col("is_error") & ~no, "text": F.when(~no, F.col("text"))}
    return rows.where("not silent").withColumns(given).select(*[c.split()[0] for c in ANSWER.split(", ")])


def answers(requests: DataFrame, tools: DataFrame, present: tuple[str, ...] = (), strict: bool = False) -> DataFrame:
    """Answers of whole sessions in a table. ``number`` is the request's place among those of its session that aren't empty."""
    order = Window.partitionBy("session").orderBy("place")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = answered(requests, tools, present).withColumn("number", F.row_number().over(order).cast("long"))
    return finished(rows.withColumn("opened", F.coalesce(F.bool_or(F.col("method") == "initialize").over(before), F.lit(False))), tools, strict)


STATE = "number long, opened boolean"
KEPT = "session string, place long, method string, id string, code int, message string, text string, is_error boolean, silent boolean, number long, opened boolean"


def in_session(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Number a session's new requests after those before, and tell which come after its opening. The state is two values a session."""
    number, opened = state.get if state.exists else (0, False)
    rows = pd.concat(list(batches)).sort_values("place", kind="stable")
    opens = (rows["method"] == "initialize").to_numpy()
    rows["number"] = range(number + 1, number + len(rows) + 1)
    rows["opened"] = (opens.cumsum() - opens > 0) | opened
    state.update((number + len(rows), bool(opened or opens.any())))
    yield rows


def answer_stream(requests: DataFrame, tools: DataFrame, present: tuple[str, ...] = (), strict: bool = False) -> DataFrame:
    """The same of a stream: requests of a session come in order, over as many batches as they like."""
    rows = answered(requests, tools, present).groupBy("session").applyInPandasWithState(in_session, KEPT, STATE, "append", GroupStateTimeout.NoTimeout)
    return finished(rows, tools, strict)
