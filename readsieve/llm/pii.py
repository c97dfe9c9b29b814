"""Personal data in texts, with DataFrame functions only.

Regular expressions propose spans, checksums confirm them (Luhn for cards, mod-97 for IBANs),
and context words in the 40 characters before or after a span adjust its score.

Spark's regular expressions give no positions.  A pass therefore puts U+0001 before and U+0002
after each match, cuts at U+0001, and adds up the lengths of the parts.  Both characters are
first replaced in the text by U+0003, which no pattern matches, so positions stay as they are.

Base kinds are email, ip, card and phone.  They are kept whatever their score.  The method adds
iban (confirmed by mod-97) and local_phone (a national number, accepted only near a context
word), unless they overlap a base span.  An IBAN may start at any word that looks like one, and
ends at the last word of the longest run that mod-97 confirms, so upper-case words and numbers
around it don't hide it; of overlapping ones the leftmost counts.  Countries and their lengths are not looked at: mod-97
confirms one wrong run in 97, and such a run before an IBAN or beyond its end sets wrong bounds.  Positions are code points from 0, the end exclusive.

The patterns are written so that a match costs time in proportion to its length: a run of
characters is tried from its start only (or from the end of the last match), and possessive
repeats never go back.  They find the same leftmost, non-overlapping matches as their plain forms:

    email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+
    ip     [0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)
    card   [0-9]([\\x20-]?[0-9])+
    phone  \\+[0-9][\\x20().0-9-]+[0-9]

So does all else: spans are gathered in chunks instead of one growing array, context is cut from
blocks of the text instead of the whole of it, and overlaps are found in one pass over sorted spans.

Edge cases: a null text counts as empty and has no spans; texts are read whole; repeated rows give
equal results; a null doc_id is kept; an empty table gives an empty result; other columns stay as
they are in ``find`` and ``redact``, whatever their names: no column is added for the time between.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "local_phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # proposes at each start, without going on behind it: what is put before the text is a copy
    "iban": r"(?<![A-Za-z0-9_])(?=([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9_]))",
    "local_phone": r"(?<![A-Za-z0-9_])[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![A-Za-z0-9_])",
}
CONTEXT = {
    "email": r"mail|contact|write|address|correo|adresse",
    "ip": r"(?:^|[^a-z0-9_])ip(?:[^a-z0-9_]|$)|host|server|address|login|adresse",
    "card": r"card|visa|credit|payment|tarjeta|karte|carte",
    "phone": r"phone|call|tel|fax|mobile|contact|movil|anruf",
    "iban": r"iban|bank|account|konto|compte|cuenta",
    "local_phone": r"phone|call|tel(?:[^a-z]|$)|fax|mobile|telefon",
}
#: Score of a confirmed span without context; a context word adds CONTEXT_SCORE.
SCORES = {"email": 0.8, "ip": 0.6, "card": 0.85, "phone": 0.65, "iban": 0.85, "local_phone": 0.4}
CONTEXT_SCORE = 0.15
#: Added kinds are kept from this score on.
ACCEPTED = 0.5
CONTEXT_CHARACTERS = 40
#: Items that one array of a fold gathers, and characters of a block of text.
CHUNK, BLOCK = 64, 512

SPAN = "struct<start:int,kind:int,end:int,match:string>"
SCORED_SPAN = SPAN.replace(">", ",score:double>")


def _folded(values: Column, state: Column, step, kind: str) -> Column:
    """What ``step(state, value) -> (state, array)`` emits along an array, as one array<kind>.

    A fold copies what it has gathered at each step. So the first pass keeps only the state (a number)
    that each chunk begins with, and the second gathers within chunks.
    """
    none = F.array().cast(f"array<{kind}>")

    def one(so_far: Column, value: Column) -> Column:
        after, emitted = step(so_far.state, value)
        return F.struct(after.alias("state"), F.concat(so_far.out, emitted).alias("out"))

    def begun(states: Column, chunk: Column) -> Column:
        return F.concat(states, F.array(F.aggregate(chunk, F.element_at(states, -1), lambda x, value: step(x, value)[0])))

    def gathered(chunk: Column, begin: Column) -> Column:
        return F.aggregate(chunk, F.struct(begin.alias("state"), none.alias("out")), one, lambda x: x.out)

    def whole(chunks: Column) -> Column:
        states = F.slice(F.aggregate(chunks, F.array(state), begun), F.lit(1), F.size(chunks))
        return F.flatten(F.zip_with(chunks, states, gathered))

    def cut(array: Column) -> Column:
        last = F.floor(F.greatest(F.size(array) - 1, F.lit(0)) / CHUNK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(array, k * CHUNK + 1, CHUNK))

    return let(let(values, cut), whole)


def _blocks(text: Column) -> Column:
    """The text in blocks of BLOCK code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def _cut(blocks: Column, start: Column, end: Column) -> Column:
    """The code points from start up to end."""
    first = F.floor(start / BLOCK).cast("int")
    some = F.slice(blocks, first + 1, F.floor((end - 1) / BLOCK).cast("int") - first + 1)
    return F.when(end > start, F.substring(F.array_join(some, ""), start - first * BLOCK + 1, end - start)).otherwise("")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Every second digit from the right counts double, less 9 if above 9."""
    doubled = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, doubled(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda total, d: total + F.coalesce(d, F.lit(0))) % 10 == 0


def _mod97(iban: Column) -> Column:
    """The first four characters go last, letters count from 10 on, and the remainder is 1."""
    compact = F.replace(iban, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(compact, 5, 40), F.substring(compact, 1, 4))
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    step = lambda rest, c: F.when(c == "", rest).when(value(c) > 9, (rest * 100 + value(c)) % 97).otherwise((rest * 10 + value(c)) % 97)
    return F.length(compact).between(15, 34) & (F.aggregate(F.split(moved, ""), F.lit(0), step) == 1)


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        part = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return match.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        digits = _digits(match)
        return F.length(digits).between(14, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(_digits(match)).between(10, 15)
    return F.lit(True)


def _confirmed_iban(proposed: Column) -> Column:
    """The longest run of words from the start that mod-97 confirms, or null."""
    words = F.split(proposed, " ")
    runs = F.transform(F.sequence(F.size(words), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(words, 1, k), " "))
    return F.get(F.filter(runs, _mod97), F.lit(0))


def _ibans(text: Column, present: Column) -> Column:
    """As ``_matches``; a part holds a copy of the proposal, then the text from its start on."""
    none, kind = F.array().cast(f"array<{SPAN}>"), F.lit(KINDS.index("iban"))

    def step(at: Column, part: Column) -> tuple[Column, Column]:
        marked = F.instr(part, "\u0002") > 0
        proposed = F.substring_index(part, "\u0002", 1)
        kept = F.filter(F.array(F.when(marked, _confirmed_iban(proposed))), lambda m: m.isNotNull())
        spans = F.transform(kept, lambda m: F.struct(at.alias("start"), kind.alias("kind"), (at + F.length(m)).alias("end"), m.alias("match")))
        return at + F.length(part) - F.when(marked, F.length(proposed) + 1).otherwise(F.lit(0)), spans

    def leftmost(free_from: Column, span: Column) -> tuple[Column, Column]:
        free = span.start >= free_from
        return F.when(free, span.end).otherwise(free_from), F.when(free, F.array(span)).otherwise(none)

    parts = F.split(F.regexp_replace(text, PATTERNS["iban"], "\u0001$1\u0002"), "\u0001")
    return F.when(present, _folded(_folded(parts, F.lit(0), step, SPAN), F.lit(0), leftmost, SPAN)).otherwise(none)


def _matches(kind: str, text: Column, present: Column) -> Column:
    """The confirmed spans of a kind. ``present``: what a text with a match surely fulfils."""
    none = F.array().cast(f"array<{SPAN}>")

    def step(at: Column, part: Column) -> tuple[Column, Column]:
        match = F.substring_index(part, "\u0002", 1)
        marked = F.instr(part, "\u0002") > 0
        span = F.struct(at.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (at + F.length(match)).alias("end"), match.alias("match"))
        return at + F.length(part) - marked.cast("int"), F.when(marked & _valid(kind, match), F.array(span)).otherwise(none)

    parts = F.split(F.regexp_replace(text, PATTERNS[kind], "\u0001$0\u0002"), "\u0001")
    return F.when(present, _folded(parts, F.lit(0), step, SPAN)).otherwise(none)


def _by_kind(values: dict, kind: Column) -> Column:
    return F.element_at(F.array(*(F.lit(values[k]) for k in KINDS)), kind + 1)


def _scored(spans: Column, text: Column) -> Column:
    """Adds the score to each span, by the context words before and after it."""

    def score(span: Column, blocks: Column) -> Column:
        before = F.lower(_cut(blocks, F.greatest(span.start - CONTEXT_CHARACTERS, F.lit(0)), span.start))
        after = F.lower(_cut(blocks, span.end, span.end + CONTEXT_CHARACTERS))
        near = F.lit(False)
        for i, kind in enumerate(KINDS):
            near = near | ((span.kind == i) & (before.rlike(CONTEXT[kind]) | after.rlike(CONTEXT[kind])))
        value = F.round(_by_kind(SCORES, span.kind) + F.when(near, F.lit(CONTEXT_SCORE)).otherwise(F.lit(0.0)), 2)
        return F.struct(span.start.alias("start"), span.kind.alias("kind"), span.end.alias("end"), span.match.alias("match"), value.alias("score"))

    return let(_blocks(text), lambda blocks: F.transform(spans, lambda s: score(s, blocks)))


def _accepted(spans: Column) -> Column:
    """Of spans by start and kind: the base kinds, and of the added ones those that score well and overlap none of these."""
    base = lambda s: s.kind < len(BASE_KINDS)
    reached = lambda end, s: (F.when(base(s), F.greatest(end, s.end)).otherwise(end), F.array(end))
    coming = lambda start, s: (F.when(base(s), F.least(start, s.start)).otherwise(start), F.array(start))
    before = _folded(spans, F.lit(0), reached, "int")
    after = F.reverse(_folded(F.reverse(spans), F.lit(2**31 - 1), coming, "int"))
    around = F.zip_with(before, after, lambda a, b: F.struct(a.alias("end"), b.alias("start")))
    keep = lambda s, x: base(s) | ((s.score >= ACCEPTED) & (x.end <= s.start) & (x.start >= s.end))
    marked = F.zip_with(spans, around, lambda s, x: F.when(keep(s, x), s))
    return F.when(F.exists(spans, lambda s: ~base(s)), F.filter(marked, lambda s: s.isNotNull())).otherwise(spans)


def spans_of(text: Column) -> Column:
    """Array of (start, kind, end, match, score) by start, then kind as listed in KINDS."""

    def found(clean: Column) -> Column:
        has = lambda c: F.instr(clean, c) > 0
        digit = clean.rlike("[0-9]")
        present = {"email": has("@"), "ip": digit, "card": digit, "phone": has("+"), "iban": digit, "local_phone": digit}
        each = [_ibans(clean, present[k]) if k == "iban" else _matches(k, clean, present[k]) for k in KINDS]
        none = F.array().cast(f"array<{SCORED_SPAN}>")
        return let(F.array_sort(F.concat(*each)), lambda spans: F.when(F.size(spans) > 0, let(_scored(spans, clean), _accepted)).otherwise(none))

    return let(F.translate(F.coalesce(text.cast("string"), F.lit("")), "\u0001\u0002", "\u0003\u0003"), found)


def find(docs: DataFrame, text: str = "text", name: str = "pii") -> DataFrame:
    """Adds a column of spans (``spans_of``); a column of this name is replaced."""
    return docs.withColumn(name, spans_of(F.col(text)))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replaces each span in the text by its kind in brackets; overlapping spans become one."""

    def step(at: Column, span: Column, blocks: Column) -> tuple[Column, Column]:
        tag = F.concat(F.lit("["), F.upper(_by_kind({k: k for k in KINDS}, span.kind)), F.lit("]"))
        pieces = F.when(span.start >= at, F.array(_cut(blocks, at, span.start), tag)).otherwise(F.array().cast("array<string>"))
        return F.greatest(at, span.end), pieces

    def joined(spans: Column, blocks: Column) -> Column:
        rest = _cut(blocks, F.array_max(F.transform(spans, lambda s: s.end)), F.length(text))
        return F.concat(F.array_join(_folded(spans, F.lit(0), lambda at, s: step(at, s, blocks), "string"), ""), rest)

    def cleaned(spans: Column) -> Column:
        return F.when(F.size(spans) > 0, let(_blocks(F.col(text)), lambda blocks: joined(spans, blocks))).otherwise(F.col(text))

    return docs.withColumn(text, let(spans_of(F.col(text)), cleaned))


def _said(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", _by_kind({k: k for k in KINDS}, s.kind), s.start.cast("string"), s.end.cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, the digest of base spans, all spans and their scores."""
    found = find(docs.select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("pii", lambda s: s.kind == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *(count(kind) for kind in BASE_KINDS),
        F.sha2(_said(F.filter("pii", lambda s: s.kind < len(BASE_KINDS))).cast("binary"), 256).alias("base_sha256"),
        _said(F.col("pii")).alias("spans"),
        F.array_join(F.transform("pii", lambda s: s.score.cast("string")), ",").alias("scores"),
    )


def _oracle_sql() -> str:
    """The patterns in their plain forms: RE2 has neither look-behind nor possessive repeats, and needs none."""
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
        "card": r"[0-9](?:[ -]?[0-9])+",
        "phone": r"\+[0-9][ ().0-9-]+[0-9]",
        "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}\b",
        "local_phone": r"\b[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}\b",
    }
    cut = "string_split(regexp_replace(t, '({})', chr(1) || '\\1' || chr(2), 'g'), chr(1))"
    starts = plain | {"iban": r"\b[A-Z]{2}[0-9]{2}"}
    split = " UNION ALL ".join(f"SELECT doc_id, t, {i} AS kind, {cut.format(starts[k])} AS parts FROM clean" for i, k in enumerate(KINDS))
    by_kind = lambda f: "CASE kind " + " ".join(f"WHEN {i} THEN {f(k)}" for i, k in enumerate(KINDS)) + " END"
    luhn = "list_sum(list_transform(range(1, length(digits) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr(digits, -i, 1) AS INT) ELSE CAST(substr(digits, -i, 1) AS INT) * 2 - CASE WHEN CAST(substr(digits, -i, 1) AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
    moved = "substr(replace(match, ' ', ''), 5) || substr(replace(match, ' ', ''), 1, 4)"
    number = "list_transform(string_split(" + moved + ", ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)"
    mod97 = f"list_reduce(list_prepend(0, {number}), lambda r, x: CASE WHEN x > 9 THEN (r * 100 + x) % 97 ELSE (r * 10 + x) % 97 END) = 1"
    valid = {
        "email": "true",
        "ip": "list_bool_and(list_transform(string_split(match, '.'), lambda p: length(ltrim(p, '0')) <= 3 AND CAST('0' || right(ltrim(p, '0'), 3) AS INT) <= 255))",
        "card": f"length(digits) BETWEEN 14 AND 19 AND {luhn}",
        "phone": "length(digits) BETWEEN 10 AND 15",
        "iban": "true",
        "local_phone": "true",
    }
    near = by_kind(lambda k: f"(regexp_matches(before, '{CONTEXT[k]}') OR regexp_matches(after, '{CONTEXT[k]}'))")
    runs = "list_transform(range(len(words), 0, -1), lambda k: array_to_string(words[1:k], ' '))"
    confirmed = f"list_filter(runs, lambda match: length(replace(match, ' ', '')) BETWEEN 15 AND 34 AND {mod97})[1]"
    iban = KINDS.index("iban")
    return f"""
WITH clean AS (SELECT doc_id, translate(coalesce(text, ''), chr(1) || chr(2), chr(3) || chr(3)) AS t FROM documents),
split AS ({split}),
parts AS (SELECT doc_id, kind, t, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM split WHERE len(parts) > 1),
placed AS (
  SELECT *, split_part(part, chr(2), 1) AS match, regexp_replace(split_part(part, chr(2), 1), '[^0-9]', '', 'g') AS digits,
         coalesce(sum(length(part) - CASE WHEN i > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, kind ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first
  FROM parts),
-- an IBAN may start wherever two letters and two digits start a word; it ends at the last word of the longest run that is confirmed
proposed AS (
  SELECT doc_id, t, CAST(first AS BIGINT) AS first, regexp_extract(substr(t, CAST(first AS BIGINT) + 1, 70), '^{plain["iban"]}') AS proposal
  FROM placed WHERE i > 1 AND kind = {iban}),
in_runs AS (SELECT doc_id, t, first, {runs.replace("words", "string_split(proposal, ' ')")} AS runs FROM proposed WHERE proposal <> ''),
in_order AS (
  SELECT doc_id, any_value(t) AS t, list([{{'first': first, 'past': first + length(match)}}] ORDER BY first) AS spans
  FROM (SELECT doc_id, t, first, {confirmed} AS match FROM in_runs) WHERE match IS NOT NULL GROUP BY doc_id),
leftmost AS (
  SELECT doc_id, t, unnest(list_reduce(spans, lambda kept, next: CASE WHEN next[1].first >= kept[-1].past THEN list_concat(kept, next) ELSE kept END)) AS span FROM in_order),
spans AS (
  SELECT doc_id, kind, t, CAST(first AS BIGINT) AS first, CAST(first AS BIGINT) + length(match) AS past FROM placed WHERE i > 1 AND kind <> {iban} AND {by_kind(valid.get)}
  UNION ALL SELECT doc_id, {iban}, t, span.first, span.past FROM leftmost),
confirmed AS (
  SELECT doc_id, kind, first, past, lower(substr(t, greatest(first - {CONTEXT_CHARACTERS}, 0) + 1, least(first, {CONTEXT_CHARACTERS}))) AS before,
         lower(substr(t, past + 1, {CONTEXT_CHARACTERS})) AS after
  FROM spans),
scored AS (
  SELECT *, round({by_kind(lambda k: f"CAST({SCORES[k]} AS DOUBLE)")} + CASE WHEN {near} THEN CAST({CONTEXT_SCORE} AS DOUBLE) ELSE 0 END, 2) AS score FROM confirmed),
base AS (SELECT * FROM scored WHERE kind < {len(BASE_KINDS)}),
kept AS (
  SELECT * FROM base UNION ALL
  SELECT * FROM scored s WHERE kind >= {len(BASE_KINDS)} AND score >= {ACCEPTED}
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = s.doc_id AND b.first < s.past AND s.first < b.past)),
said AS (SELECT *, {by_kind(lambda k: f"'{k}'")} || ':' || first || ':' || past AS span FROM kept),
found AS (
  SELECT doc_id, {", ".join(f"count(*) FILTER (kind = {i}) AS n_{k}" for i, k in enumerate(BASE_KINDS))},
         sha256(coalesce(string_agg(span, ',' ORDER BY first, kind) FILTER (kind < {len(BASE_KINDS)}), '')) AS base_sha256,
         string_agg(span, ',' ORDER BY first, kind) AS spans, string_agg(CAST(score AS VARCHAR), ',' ORDER BY first, kind) AS scores
  FROM said GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE_KINDS)}, coalesce(base_sha256, sha256('')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
FROM clean LEFT JOIN found USING (doc_id)"""


ORACLE_SQL = _oracle_sql()
