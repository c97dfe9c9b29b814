"""Chat formatting: link tool calls to their results, order them, check arguments, write canonical JSON.

DataFrame functions only.

``calls``: conv_id, call_id, turn, name, arguments (JSON text), after (ids of calls of the same
conversation that must come first).  ``results``: conv_id, call_id, turn, content.

* Linking is a join on (conv_id, call_id).  Each call, repeated ids included, is linked to the first
  result of its id (by turn, then content).
  Contents move once, to their calls; only those of ids that have several results, or no call, move again.
* Order.  A call stands at its turn; within a turn by its level, 0 if it waits for no call and else
  one above the highest it waits for; then by call_id.  Levels are found in rounds, each of which
  frees the calls whose prerequisites are free: as many rounds as the longest chain.  The rounds of
  a conversation run within its row; one of more than ``GATHERED`` prerequisites is not gathered.
  There chains of calls that wait for one call each are shortened by doubling pointers, and only those
  that wait for several take rounds, each of which is a join.  Calls on a cycle, or behind one, are never
  freed; their level is null.
* A schema maps a tool to its parameters: name -> (type, required), the type being one of string,
  integer, number, boolean, array, object.
* Canonical JSON has keys in order, no spaces and no repeated keys (VARIANT sorts them).  A number is
  written exactly, by its digits without exponent, leading or trailing zeros: 1e2, 100 and 100.0 are
  100, and -0 is 0.  A number of more than 38 digits or places can't be held exactly; arguments
  with one are the problem ``arguments``.  (So are those with a string that begins with U+0001.)

Status: ``linked``; ``no_result``; ``cycle``; for rows of results ``orphan_result`` (no call has the id)
and ``extra_result`` (a later, different result of an id).

Edge cases: a null conv_id or call_id links to nothing; null or malformed arguments, such with anything after
their JSON, or such that are not an object, are the problem ``arguments`` and are written as null; an unknown tool is the
problem ``tool``; a prerequisite that does not exist is the problem ``after``; repeated results of
the same turn and content count once; empty tables give empty results; texts are kept whole;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import Workspace
from .common import let

# What schema_of_variant calls the types of JSON values. Whole numbers are BIGINT or a decimal without places.
VARIANT_TYPES = {
    "string": "^STRING$",
    "integer": r"^(BIGINT|DECIMAL\(\d+,0\))$",
    "number": r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$",
    "boolean": "^BOOLEAN$",
    "array": "^ARRAY<",
    "object": "^OBJECT<",
}
Schemas = dict[str, dict[str, tuple[str, bool]]]
KEY = ["conv_id", "call_id"]
#: Prerequisites of one conversation whose order is found within a row.
GATHERED = 20_000
#: Digits and places of the numbers that VARIANT holds exactly.
MOST_DIGITS = 38
#: How a number that it can't hold is written for the time between: as a string that begins so.
_TOO_LONG = '"\\u0001'

#: The tools that plain turns of a conversation stand for.
DIALOGUE: Schemas = {
    "reply": {"text": ("string", True), "turn": ("integer", True)},
    "configure": {"text": ("string", True), "turn": ("integer", True)},
}


def _problems(arguments: Column, name: Column, schemas: Schemas) -> Column:
    """Names of what is wrong, in order: tool, arguments, or parameters."""
    kind = F.schema_of_variant(arguments)
    checks = F.when(~F.coalesce(name.isin(list(schemas)), F.lit(False)), F.array(F.lit("tool")))
    checks = checks.when(arguments.isNull() | ~kind.rlike("^OBJECT<"), F.array(F.lit("arguments")))
    for tool, parameters in schemas.items():
        found = []
        for parameter, (wanted, required) in sorted(parameters.items()):
            value = F.try_variant_get(arguments, f"$['{parameter}']", "variant")
            fits = F.schema_of_variant(value).rlike(VARIANT_TYPES[wanted])
            found.append(F.when(value.isNull(), F.lit(parameter) if required else F.lit(None).cast("string")).when(~fits, F.lit(parameter)))
        checks = checks.when(name == tool, F.filter(F.array(*found), lambda x: x.isNotNull()) if found else F.array().cast("array<string>"))
    return F.coalesce(checks, F.array().cast("array<string>"))


def _exact(number: Column) -> Column:
    """A JSON number by its digits; one of too many as a string."""
    part = lambda pattern: F.regexp_extract(number, pattern, 1)
    frac, exponent = part(r"\.([0-9]+)"), part("[eE]([+-]?[0-9]+)$")
    shift = F.when(exponent == "", F.lit(0)).otherwise(exponent.try_cast("int")).cast("long")
    all_digits = F.ltrim(F.concat(part("^-?([0-9]+)"), frac), F.lit("0"))
    digits = F.rtrim(all_digits, F.lit("0"))
    n = F.length(digits)
    places = F.length(frac) - shift - (F.length(all_digits) - n)
    fill = lambda k: F.repeat(F.lit("0"), k.cast("int"))
    whole = F.concat(digits, fill(-places))
    split = F.concat(F.substring(digits, F.lit(1), (n - places).cast("int")), F.lit("."), F.substring(digits, (n - places + 1).cast("int"), n))
    value = F.when((places <= 0) & (n - places <= MOST_DIGITS), whole)
    value = value.when((places > 0) & (places < n) & (n <= MOST_DIGITS), split)
    value = value.when((places >= n) & (places <= MOST_DIGITS), F.concat(F.lit("0."), fill(places - n), digits))
    sign = F.when(number.startswith("-"), "-").otherwise("")
    return F.when(digits == "", "0").otherwise(F.coalesce(F.concat(sign, value), F.concat(F.lit(_TOO_LONG), number, F.lit('"'))))


def whole_json(text: Column) -> Column:
    """The VARIANT of a text that is one JSON value and nothing else, or null.

    The parser stops after the first value, so the text is parsed as the first element of a list of two, the other being a
    number that the text can't foresee.
    """
    parsed = lambda t: F.try_parse_json(F.concat(F.lit("["), t, F.lit(","), F.xxhash64(t).cast("string"), F.lit("]")))
    whole = lambda t: lambda v: F.when(F.try_variant_get(v, "$[1]", "bigint") == F.xxhash64(t), F.try_variant_get(v, "$[0]", "variant"))
    return let(text, lambda t: let(parsed(t), whole(t)))


def exact_numbers(text: Column) -> Column:
    """JSON with its numbers by their digits, so that VARIANT holds all of them exactly, or as strings that begin with U+0001."""
    # an escaped backslash or quote is one character, so that a string ends at the next quote
    plain = F.replace(F.replace(text, F.lit("\\\\"), F.lit("\u0003")), F.lit('\\"'), F.lit("\u0004"))
    marked = F.regexp_replace(plain, r'("[^"]*+")|(-?[0-9]++(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?)', "$1\u0001$2\u0002")

    def fixed(part: Column) -> Column:
        number = F.substring_index(part, "\u0002", 1)
        rest = F.substring(part, F.length(number) + 2, F.length(part))
        return F.when(F.instr(part, "\u0002") == 0, part).when(number == "", rest).otherwise(F.concat(_exact(number), rest))

    joined = F.array_join(F.transform(F.split(marked, "\u0001"), fixed), "")
    back = F.replace(F.replace(joined, F.lit("\u0004"), F.lit('\\"')), F.lit("\u0003"), F.lit("\\\\"))
    control = text.rlike("[\u0001-\u0004]")  # not in valid JSON
    return F.when(control, F.lit(None).cast("string")).when(text.rlike("[0-9][.eE]|[0-9]{19}"), back).otherwise(text)


def _levels_in_rows(inner: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): the calls of a conversation, and what each waits for, meet in one row.

    Calls that wait are numbered within their conversation before they meet, so a round looks levels up by number; it costs
    as much as there are calls, and prerequisites of calls that are still to be freed.
    """
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("call_id")) - 1
    numbers = inner.select(*KEY).distinct().select("conv_id", F.col("call_id").alias("before"), number.alias("number"))
    # one that doesn't wait itself has no number, and holds nothing up
    waits = inner.join(numbers, ["conv_id", "before"], "left").groupBy(*KEY).agg(F.collect_list("number").alias("before"))
    rows = waits.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("call_id", "before"))).alias("calls"))

    def rounds(before: Column) -> Column:
        """before: of each call, the numbers of those it waits for."""

        def one(state: Column, _: Column) -> Column:
            level = lambda k: F.get(state.level, k)
            freed = lambda own: F.when(~F.exists(own, lambda k: level(k).isNull()), F.coalesce(F.array_max(F.transform(own, level)), F.lit(0)) + 1)
            after = F.transform(before, lambda own, i: F.coalesce(level(i), freed(own)))

            def counted(levels: Column) -> Column:
                left = F.size(F.filter(levels, lambda x: x.isNull()))
                return let(left, lambda left: F.struct(levels.alias("level"), left.alias("left"), ((left == 0) | (left == state.left)).alias("ended")))

            return F.when(state.ended, state).otherwise(let(after, counted))

        nothing = F.transform(before, lambda _: F.lit(None).cast("int"))
        start = F.struct(nothing.alias("level"), F.size(before).alias("left"), F.lit(False).alias("ended"))
        return F.aggregate(F.sequence(F.lit(1), F.size(before)), start, one, lambda state: state.level)

    level = let(F.col("calls.before"), rounds)
    both = F.arrays_zip(F.col("calls.call_id").alias("call_id"), level.alias("level"))
    return rows.select("conv_id", F.inline(both).alias("call_id", "level"))


def _chains(inner: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """Saved: nodes (conv_id, call_id, n, before), and chains (conv_id, call_id, anchor, steps).

    n is how many waiting calls a call waits for.  Where it is one, the call follows that one in a chain, up to
    the anchor, a call of which n isn't one; pointers double, so rounds are the logarithm of the longest
    chain.  On a cycle the anchor stays within the cycle.
    """
    waiting = inner.select(*KEY).distinct()
    edges = inner.join(waiting.withColumnRenamed("call_id", "before"), ["conv_id", "before"], "left_semi")
    ahead = edges.groupBy(*KEY).agg(F.count("*").alias("n"), F.max("before").alias("before"))
    nodes = work.save(waiting.join(ahead, KEY, "left"))
    chain = work.save(nodes.where("n = 1").select(*KEY, F.col("before").alias("anchor"), F.lit(1).cast("long").alias("steps"), F.lit(True).alias("moved")))
    for _ in range(chain.count().bit_length()):  # beyond these only cycles go on
        further = chain.select("conv_id", F.col("call_id").alias("anchor"), F.col("anchor").alias("next"), F.col("steps").alias("more"))
        steps = F.col("steps") + F.coalesce("more", F.lit(0))
        after = chain.join(further, ["conv_id", "anchor"], "left").select(*KEY, F.coalesce("next", "anchor").alias("anchor"), steps.alias("steps"), F.col("next").isNotNull().alias("moved"))
        after = work.save(after)
        work.drop(chain)
        chain = after
        if not chain.where("moved").limit(1).count():
            break
    return nodes, chain.drop("moved")


def _levels_by_joins(inner: DataFrame, work: Workspace) -> DataFrame:
    """The same for conversations of any size.

    Chains, of calls that wait for one waiting call each, are followed to their ends at once; a call that waits
    for several takes its level in a round, a join, when the ends of all its chains have theirs.
    """
    nodes, chain = _chains(inner, work)
    ends = nodes.where("n is null or n > 1")
    anchored = work.save(chain.unionByName(ends.select(*KEY, F.col("call_id").alias("anchor"), F.lit(0).cast("long").alias("steps"))))
    several = inner.join(nodes.where("n > 1"), KEY, "left_semi").join(anchored.withColumnRenamed("call_id", "before"), ["conv_id", "before"])
    several = work.save(several.select(*KEY, "anchor", "steps"))
    level = work.save(ends.select(*KEY, F.when(F.col("n").isNull(), F.lit(1).cast("long")).alias("level")))
    at_anchor = lambda: level.withColumnRenamed("call_id", "anchor")
    waiting = level.where("level is null").count()
    while waiting:
        freed = F.when(F.count("level") == F.count("*"), F.max(F.col("steps") + F.col("level")) + 1)
        ready = several.join(at_anchor(), ["conv_id", "anchor"], "left").groupBy(*KEY).agg(freed.alias("freed"))
        after = work.save(level.join(ready, KEY, "left").select(*KEY, F.coalesce("level", "freed").alias("level")))
        work.drop(level)
        level, left = after, after.where("level is null").count()
        if left == waiting:
            break
        waiting = left
    # the anchor of a chain that runs into a cycle has no level
    return anchored.join(at_anchor(), ["conv_id", "anchor"], "left").select(*KEY, (F.col("level") + F.col("steps")).cast("int").alias("level"))


def levels(calls: DataFrame, work: Workspace) -> DataFrame:
    """(conv_id, call_id, level, missing) of the calls that wait for others; level is null on a cycle."""
    waits = calls.select(*KEY, "turn", F.explode("after").alias("before")).distinct()
    present = calls.select("conv_id", F.col("call_id").alias("before"), F.col("turn").alias("before_turn")).distinct()
    edges = work.save(waits.join(present, ["conv_id", "before"], "left"))
    missing = edges.groupBy(*KEY).agg(F.max(F.col("before_turn").isNull()).alias("missing"))
    # a call of an earlier turn comes first anyway
    inner = work.save(edges.where("before_turn >= turn").select(*KEY, "before").distinct())
    large = inner.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > GATHERED).select("conv_id")
    level = _levels_in_rows(inner.join(large, "conv_id", "left_anti"))
    hot = work.save(inner.join(large, "conv_id", "left_semi"))
    if hot.limit(1).count():
        level = level.unionByName(_levels_by_joins(hot, work))
    return missing.join(level.withColumn("inner", F.lit(True)), KEY, "left").select(
        *KEY, F.when(F.col("inner").isNull(), F.lit(0)).otherwise(F.col("level")).alias("level"), "missing"
    )


def _repeated(calls: DataFrame, results: DataFrame, work: Workspace) -> DataFrame:
    """Saved: the different results of ids that have several or no call, and whether there is a call (called).

    Which ids these are is found by the ids alone. All other results are the only ones of a call's id, so their
    contents move only where they are linked.
    """
    both = results.select(*KEY, F.lit(1).alias("n"), F.lit(False).alias("called")).unionByName(calls.select(*KEY, F.lit(0).alias("n"), F.lit(True).alias("called")))
    ids = both.groupBy(*KEY).agg(F.sum("n").alias("n"), F.max("called").alias("called"))
    ids = work.save(ids.where((F.col("n") > 1) | ((F.col("n") > 0) & ~F.col("called"))).drop("n"))
    return work.save(results.join(ids, KEY).distinct())


def link(calls: DataFrame, results: DataFrame, schemas: Schemas, work: Workspace | None = None) -> DataFrame:
    """One row per call, and one per result without a call or beyond the first of its id."""
    work = work or Workspace(calls.sparkSession, "chat")
    c = F.col
    after = F.coalesce(c("after"), F.array().cast("array<string>"))
    calls = calls.select(*KEY, "turn", "name", exact_numbers(c("arguments")).alias("arguments"), after.alias("after"))
    waits = calls.where(F.size("after") > 0).limit(1).count() > 0
    if waits:
        calls = work.save(calls)
    known = c("conv_id").isNotNull() & c("call_id").isNotNull()
    results = results.select(*KEY, "turn", "content")
    keyed = results.where(known)
    first = F.min(F.struct("turn", "content")).alias("first")
    repeated = _repeated(calls.where(known), keyed, work)
    of_repeated = repeated.groupBy(*KEY).agg(first, F.count("*").alias("n_results"))
    arguments = F.when(F.instr("arguments", _TOO_LONG) == 0, whole_json(c("arguments")))
    linked = calls.withColumn("arguments", arguments).join(keyed.groupBy(*KEY).agg(first), KEY, "left")
    linked = linked.join(of_repeated.select(*KEY, "n_results"), KEY, "left")
    if waits:
        linked = linked.join(levels(calls, work), KEY, "left")
        level = F.when(c("missing").isNull(), F.lit(0)).otherwise(c("level"))
    else:
        linked, level = linked.withColumn("missing", F.lit(False)), F.lit(0)
    problems = F.concat(_problems(c("arguments"), c("name"), schemas), F.when(c("missing"), F.array(F.lit("after"))).otherwise(F.array().cast("array<string>")))
    rows = linked.select(
        *KEY,
        c("turn").alias("call_turn"),
        "name",
        F.when(c("first").isNotNull(), c("first.turn")).alias("result_turn"),
        level.alias("level"),
        F.when(level.isNull(), "cycle").when(c("first").isNull(), "no_result").otherwise("linked").alias("status"),
        problems.alias("problems"),
        "arguments",
        c("first.content").alias("content"),
        F.when(c("first").isNull(), F.lit(0).cast("long")).otherwise(F.coalesce("n_results", F.lit(1).cast("long"))).alias("n_results"),
    )
    is_first = c("turn").eqNullSafe(c("first.turn")) & c("content").eqNullSafe(c("first.content"))
    rest = repeated.join(of_repeated, KEY).where(~c("called") | ~is_first).drop("first")
    unknown = results.where(~known).distinct().withColumns({"called": F.lit(False), "n_results": F.lit(1).cast("long")})
    others = rest.unionByName(unknown).select(
        *KEY,
        F.lit(None).cast("long").alias("call_turn"),
        F.lit(None).cast("string").alias("name"),
        c("turn").alias("result_turn"),
        F.lit(None).cast("int").alias("level"),
        F.when(c("called"), "extra_result").otherwise("orphan_result").alias("status"),
        F.array().cast("array<string>").alias("problems"),
        F.lit(None).cast("variant").alias("arguments"),
        "content",
        "n_results",
    )
    both = rows.unionByName(others)
    exchange = F.to_variant_object(F.struct("arguments", c("call_id").alias("id"), "name", c("content").alias("result"), "status"))
    return both.withColumn("valid", c("status").isin("linked", "no_result") & (F.size("problems") == 0)).select(
        *KEY, "call_turn", "level", "result_turn", "name", "status", "valid", F.array_join("problems", ",").alias("problems"), "n_results", F.to_json(exchange).alias("json")
    )


def from_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of a table conv_id, turn, role, text.

    A text that is one JSON object and nothing else may hold ``tool_calls``, a list of {id, name, arguments, after} or of
    {id, function: {name, arguments}, after}, or ``tool_call_id`` and ``content``.  Arguments may be an object, or a string with
    its JSON.  What a text with calls says besides in ``content`` is dialogue as if it stood alone, unless it is empty or
    the result that ``tool_call_id`` names.  Any other turn is dialogue: a user or system turn calls
    ``reply`` or ``configure`` by the id ``turn-<turn>``, with its text and turn as arguments, and an
    assistant turn is the result of the turn before it.  So is a turn of any other role, or of none
    (null).  A text with an empty list ``tool_calls`` and no ``tool_call_id`` makes no call and is
    dialogue.  So every turn gives at least one call or result.
    """
    c = F.col
    call = "array<struct<id:string,name:string,arguments:variant,function:struct<name:string,arguments:variant>,after:array<string>>>"
    data = F.when(F.substring(F.ltrim("text"), 1, 1) == "{", whole_json(exact_numbers(c("text"))))
    parsed = messages.select("conv_id", c("turn").cast("long").alias("turn"), "role", "text", data.alias("data")).select(
        "*",
        F.try_variant_get("data", "$.tool_calls", call).alias("tool_calls"),
        F.ltrim(F.try_variant_get("data", "$.tool_call_id", "string"), F.lit("\u0001")).alias("answers"),
        F.ltrim(F.try_variant_get("data", "$.content", "string"), F.lit("\u0001")).alias("content"),
    )
    plain = (c("tool_calls").isNull() | (F.size("tool_calls") == 0)) & c("answers").isNull()
    asks = F.coalesce(c("role").isin("user", "system"), F.lit(False))
    besides = c("answers").isNull() & (F.size("tool_calls") > 0) & (c("content") != "")
    dialogue = parsed.where(plain | besides).withColumn("text", F.when(plain, c("text")).otherwise(c("content")))
    spoken = dialogue.where(asks)
    said = spoken.select(
        "conv_id",
        F.concat(F.lit("turn-"), c("turn").cast("string")).alias("call_id"),
        "turn",
        F.when(c("role") == "user", "reply").otherwise("configure").alias("name"),
        F.to_json(F.struct("text", "turn"), {"ignoreNullFields": "false"}).alias("arguments"),
        F.array().cast("array<string>").alias("after"),
    )
    made = parsed.where("tool_calls is not null").select("conv_id", "turn", F.explode("tool_calls").alias("t")).select(
        "*", F.coalesce("t.arguments", "t.function.arguments").alias("given")
    ).select(
        "conv_id",
        c("t.id").alias("call_id"),
        "turn",
        F.coalesce("t.name", "t.function.name").alias("name"),
        F.when(F.schema_of_variant("given") == "STRING", F.try_variant_get("given", "$", "string")).otherwise(F.to_json("given")).alias("arguments"),
        c("t.after").alias("after"),
    )
    answered = parsed.where("answers is not null").select("conv_id", c("answers").alias("call_id"), "turn", "content")
    heard = dialogue.where(~asks).select(
        "conv_id", F.concat(F.lit("turn-"), (c("turn") - 1).cast("string")).alias("call_id"), "turn", c("text").alias("content")
    )
    return said.unionByName(made), answered.unionByName(heard)


def format_conversations(messages: DataFrame, schemas: Schemas = DIALOGUE, work: Workspace | None = None) -> DataFrame:
    """All exchanges of a table of conversations."""
    calls, results = from_messages(messages)
    return link(calls, results, schemas, work)


# The tables' conversations are dialogue without JSON; of those each id has one call and one result.
ORACLE_SQL = """
WITH calls AS (
  SELECT conv_id, 'turn-' || turn AS call_id, turn, text, CASE WHEN role = 'user' THEN 'reply' ELSE 'configure' END AS name
  FROM conversations WHERE role IN ('user', 'system')),
results AS (
  SELECT conv_id, 'turn-' || (turn - 1) AS call_id, turn, text FROM conversations WHERE role IS NULL OR role NOT IN ('user', 'system')),
linked AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id,
         c.turn AS call_turn, r.turn AS result_turn, c.name, c.text AS asked, r.text AS answered,
         CASE WHEN c.turn IS NULL THEN 'orphan_result' WHEN r.turn IS NULL THEN 'no_result' ELSE 'linked' END AS status
  FROM calls c FULL JOIN results r ON c.conv_id = r.conv_id AND c.call_id = r.call_id)
SELECT conv_id, call_id, call_turn, CASE WHEN call_turn IS NULL THEN NULL ELSE CAST(0 AS INTEGER) END AS level, result_turn, name, status,
       status <> 'orphan_result' AND asked IS NOT NULL AS valid,
       CASE WHEN status <> 'orphan_result' AND asked IS NULL THEN 'text' ELSE '' END AS problems,
       CAST(CASE WHEN result_turn IS NULL THEN 0 ELSE 1 END AS BIGINT) AS n_results,
       CAST(json_object('arguments', CASE WHEN call_turn IS NULL THEN NULL ELSE json_object('text', asked, 'turn', call_turn) END,
                        'id', call_id, 'name', name, 'result', answered, 'status', status) AS VARCHAR) AS json
FROM linked"""
