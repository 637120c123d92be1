"""Secret scans by DataFrame functions alone: patterns, and sliding-window entropy of candidate strings.

A pattern's spans come from cutting the text at the pattern: the lengths of the pieces and of the matches
between them give every position.  Candidate strings are long runs of the characters that keys are written
in, of mixed classes (letters with digits, or letters of changing case).  A window slides over a candidate,
and its Shannon entropy follows from counts alone: a character that enters or leaves changes one count, which
is carried along, and so one term of the sum.  Windows whose entropy reaches the bound of the candidate's class (hexadecimal, or
any) make a span from the first such window's start to the last one's end.  Allow-listed strings and
candidates that overlap a pattern's span add none.

The sum over a window of W characters is sum(c * log2(c)) over the counts c, and the entropy is log2(W)
minus that over W.  Terms are whole millionths, so sums are exact in any order.

Defined results: a null text is empty; a text without secrets has zero counts, the hash of the empty string
and empty spans; repeated rows each get theirs; an empty table gives no rows; other columns are ignored.  Time
grows with the length of a text and of a candidate, and with the 3/2 power of the number of matches in a text.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: The same with a look at the next character first, which spares most places the trial of every name.
ASSIGN_SCAN = rf"(?=[AaPpSsTt]){ASSIGN}"
ASSIGN_LEAST = 6
#: A run that is too short fails whole, so the least length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}"
MIXED = r"[0-9].*[A-Za-z]|[A-Za-z].*[0-9]|[a-z][A-Z].*[a-z][A-Z]"
HEX_ONLY = r"^[0-9A-Fa-f-]+$"
#: Least bits of entropy a character, by class.
BITS = {"hex": 3.0, "any": 3.8}
SCALE = 1_000_000
#: Strings that look random and are none of ours: UUIDs, digests with their name, examples, sequences, digits with separators, paths of words.
ALLOW = r"^[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}$|^sha(?:1|256|384|512)[-_=]|EXAMPLE|[Ee]xample|abcdefgh|ABCDEFGH|01234567|12345678|^[0-9_=+/-]+$"
PATHS = r"^/?(?:[A-Za-z_-]+/)+[A-Za-z_-]*$"

#: The characters of candidates; a window's counts of them are packed, PACK of COUNT_BITS bits to a long.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
COUNT_BITS = (WINDOW + 1).bit_length()
PACK = 62 // COUNT_BITS
LONGS = -(-len(ALPHABET) // PACK)
SPANS = "array<struct<start:int,k:int,kind:string,end:int,s:string>>"

TERMS = [round(SCALE * c * math.log2(c)) if c else 0 for c in range(WINDOW + 1)]


def most(bits: float) -> int:
    """The largest sum of terms of a window whose entropy is ``bits`` or more."""
    return math.floor(SCALE * WINDOW * (math.log2(WINDOW) - bits))


def _bound(value, body):
    """``body`` of a value that is worked out once (what stands in a lambda is worked out anew for every element)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _whole(n):
    return n.cast("int")


def pattern_spans(text, pattern: str, kind: str, holds=None):
    """Array of (start, kind number, kind, end, match), in order, for every match that holds.

    Starts are sums of the lengths of what stands before, taken in groups of about the square root of the
    number of matches: inside each group, then over the groups.
    """
    empty = F.array().cast(SPANS)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def group(pairs, size):
        """Of pairs (gap, match): struct(out: spans that count from the group's beginning, at: the group's length)."""

        def step(acc, x):
            start = acc["at"] + x["g"]
            span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("k"), F.lit(kind).alias("kind"), (start + F.length(x["m"])).alias("end"), x["m"].alias("s"))
            return F.struct((start + F.length(x["m"])).alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

        none = F.struct(F.lit(0).alias("at"), empty.alias("out"))
        return lambda k: F.aggregate(F.slice(pairs, k * size + 1, size), none, step)

    def placed(groups):
        """The groups' spans, each moved by the lengths of the groups before."""
        step = lambda acc, g: F.struct((acc["at"] + g["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        starts = F.aggregate(groups, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), step, lambda a: a["out"])
        move = lambda x, by: F.struct((x["start"] + by).alias("start"), x["k"].alias("k"), x["kind"].alias("kind"), (x["end"] + by).alias("end"), x["s"].alias("s"))
        return F.flatten(F.zip_with(groups, starts, lambda g, by: F.transform(g["out"], lambda x: move(x, by))))

    def spans(matches):
        gaps = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
        pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches, lambda g, m: F.struct(g.alias("g"), m.alias("m")))
        size = _whole(F.ceil(F.sqrt(F.size(matches))))
        grouped = _bound(F.struct(pairs.alias("p"), size.alias("n")), lambda b: F.transform(F.sequence(F.lit(0), _whole((F.size(b["p"]) - 1) / b["n"])), group(b["p"], b["n"])))
        every = _bound(grouped, placed)
        return every if holds is None else F.filter(every, lambda x: holds(x["s"]))

    return _bound(found, lambda m: F.when(F.size(m) == 0, empty).otherwise(spans(m)))


def overlaps(spans, start, end):
    """Whether one of ``spans`` (in order, apart from each other) overlaps start to end: the last that begins before the end is found by halving."""
    zero, n = F.lit(0), F.size(spans)

    def step(acc, _):
        mid = _whole((acc["lo"] + acc["hi"]) / 2)
        before = F.get(spans, mid)["start"] < end
        return F.when(acc["lo"] >= acc["hi"], acc).when(before, F.struct((mid + 1).alias("lo"), acc["hi"].alias("hi"))).otherwise(F.struct(acc["lo"].alias("lo"), mid.alias("hi")))

    rounds = F.sequence(F.lit(1), _whole(F.ceil(F.log2(n + 1))) + 1)
    last = F.aggregate(rounds, F.struct(zero.alias("lo"), n.alias("hi")), step, lambda a: a["lo"]) - 1
    return F.when(n == 0, False).otherwise(F.coalesce(F.get(spans, last)["end"] > start, F.lit(False)))


def _places(s):
    """For each character of a candidate where its count stands in the packed counts: struct(word, shift, unit: 1 at that place)."""
    number = lambda c: F.instr(F.lit(ALPHABET), c) - 1
    shift = lambda k: (k % PACK * COUNT_BITS).cast("int")
    place = lambda k: F.struct(_whole(k / PACK).alias("word"), shift(k).alias("shift"), F.call_function("shiftleft", F.lit(1).cast("long"), shift(k)).alias("unit"))
    return F.transform(F.transform(F.filter(F.split(s, ""), lambda c: c != ""), number), place)


def hot_window(s):
    """(lo, hi): the first start and last end of the windows of ``s`` whose entropy reaches their class's bound; hi 0 if none.

    The window's counts go along, packed into a few longs: for every character that enters one count goes up,
    and the one that leaves takes one down.
    """
    bound = F.when(s.rlike(HEX_ONLY), most(BITS["hex"])).otherwise(most(BITS["any"]))
    gain = F.array(*[F.lit(b - a) for a, b in zip(TERMS, TERMS[1:], strict=False)])
    count = lambda counts, x: F.call_function("shiftright", F.get(counts, x["word"]), x["shift"]).bitwiseAND(F.lit((1 << COUNT_BITS) - 1)).cast("int")
    nothing = F.struct(F.lit(-1).alias("word"), F.lit(0).alias("shift"), F.lit(0).cast("long").alias("unit"))

    def moves(places):
        """For each place the character that enters and the one that leaves."""
        gone = F.concat(F.array_repeat(nothing, WINDOW), F.slice(places, F.lit(1), F.greatest(F.size(places) - WINDOW, F.lit(0))))
        return F.zip_with(places, F.slice(gone, F.lit(1), F.size(places)), lambda a, b: F.struct(a.alias("c"), b.alias("gone")))

    def walk(b):
        def step(acc, x):
            c, gone = x["c"], x["gone"]
            same = (c["word"] == gone["word"]) & (c["shift"] == gone["shift"])
            lost = F.when(gone["word"] < 0, 0).otherwise(F.get(b["gain"], count(acc["n"], gone) - 1))
            total = F.when(same, acc["sum"]).otherwise(acc["sum"] + F.get(b["gain"], count(acc["n"], c)) - lost)
            counts = F.transform(acc["n"], lambda v, w: v + F.when(w == c["word"], c["unit"]).otherwise(0) - F.when(w == gone["word"], gone["unit"]).otherwise(0))
            return F.struct((acc["i"] + 1).alias("i"), counts.alias("n"), total.alias("sum"), acc["lo"].alias("lo"), acc["hi"].alias("hi"))

        def mark(acc):
            hot = (acc["i"] >= WINDOW) & (acc["sum"] <= b["bound"])
            lo = F.when(hot & (acc["hi"] == 0), acc["i"] - WINDOW).otherwise(acc["lo"])
            return F.struct(acc["i"].alias("i"), acc["n"].alias("n"), acc["sum"].alias("sum"), lo.alias("lo"), F.when(hot, acc["i"]).otherwise(acc["hi"]).alias("hi"))

        zero = F.struct(F.lit(0).alias("i"), F.array_repeat(F.lit(0).cast("long"), LONGS).alias("n"), F.lit(0).alias("sum"), F.lit(0).alias("lo"), F.lit(0).alias("hi"))
        return F.aggregate(b["moves"], zero, lambda acc, x: _bound(step(acc, x), mark), lambda a: F.struct(a["lo"].alias("lo"), a["hi"].alias("hi")))

    return _bound(F.struct(_bound(_places(s), moves).alias("moves"), gain.alias("gain"), bound.alias("bound")), walk)


def _is_mixed(s):
    """Letters with digits, or two changes from a small to a capital letter (MIXED, asked for so that no string takes more than a pass)."""
    return (s.rlike("[0-9]") & s.rlike("[A-Za-z]")) | (F.regexp_count(s, F.lit("[a-z][A-Z]")) >= 2)


def _is_allowed(s):
    """ALLOW or PATHS, the latter asked for piece by piece: its groups would take a frame of the stack each."""
    path = s.rlike(r"^/?[A-Za-z_-]+/") & ~F.contains(s, F.lit("//")) & ~s.rlike(r"[^A-Za-z_/-]")
    return s.rlike(ALLOW) | path


def _joined(spans):
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def scan(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, n_assign, n_access, n_hex, base_sha256, n_entropy, spans."""
    text = F.col("t")
    long_value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= ASSIGN_LEAST
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("t")).select(
        "doc_id",
        pattern_spans(text, ASSIGN_SCAN, "assign", long_value).alias("assign"),
        pattern_spans(text, ACCESS, "access").alias("access"),
        pattern_spans(text, HEX, "hex").alias("hex"),
        pattern_spans(text, CANDIDATE, "entropy", lambda m: _is_mixed(m) & ~_is_allowed(m)).alias("candidates"),
    )

    def marked(x):
        free = F.filter(x["candidates"], lambda c: ~overlaps(x["assign"], c["start"], c["end"]) & ~overlaps(x["access"], c["start"], c["end"]) & ~overlaps(x["hex"], c["start"], c["end"]))
        hot = F.transform(free, lambda c: F.struct(c.alias("c"), hot_window(c["s"]).alias("w")))
        return F.transform(
            F.filter(hot, lambda h: h["w"]["hi"] > 0),
            lambda h: F.struct((h["c"]["start"] + h["w"]["lo"]).alias("start"), h["c"]["k"].alias("k"), h["c"]["kind"].alias("kind"), (h["c"]["start"] + h["w"]["hi"]).alias("end"), h["c"]["s"].alias("s")),
        )

    full = found.select("doc_id", "assign", "access", "hex", F.concat("assign", "access", "hex").alias("base"), _bound(F.struct("candidates", "assign", "access", "hex"), marked).alias("entropy"))
    return full.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        F.size("entropy").cast("long").alias("n_entropy"),
        _joined(F.concat("base", "entropy")).alias("spans"),
    )


def _sql_spans(kind: str, pattern: str, holds: str) -> str:
    """SQL for the spans of one kind: doc_id, k, kind, s, and code-point positions."""
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, {KINDS.index(kind)} AS k, '{kind}' AS kind, m[i] AS s,
        list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS a
        FROM (SELECT doc_id, g, m, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, string_split_regex(t, '{p}') AS g, regexp_extract_all(t, '{p}') AS m FROM d)) WHERE {holds}"""


def oracle() -> str:
    """The same result as one DuckDB statement; entropy sums are taken window by window."""
    assign = ASSIGN.replace("'", "''")
    terms = "[" + ", ".join(map(str, TERMS)) + "]"
    mixed, allow = MIXED.replace("'", "''"), f"{ALLOW}|{PATHS}".replace("'", "''")
    return f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        base AS ({_sql_spans("assign", ASSIGN, f"length(regexp_extract(m[i], '{assign}', 2)) >= {ASSIGN_LEAST}")}
            UNION ALL {_sql_spans("access", ACCESS, "true")}
            UNION ALL {_sql_spans("hex", HEX, "true")}),
        cand AS (SELECT * FROM ({_sql_spans("entropy", CANDIDATE, f"regexp_matches(m[i], '{mixed}') AND NOT regexp_matches(m[i], '{allow}')")}) c
            WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = c.doc_id AND b.a < c.a + length(c.s) AND c.a < b.a + length(b.s))),
        win AS (SELECT doc_id, k, kind, s, a, i, string_split(substr(s, i, {WINDOW}), '') AS w FROM (SELECT *, unnest(range(1, length(s) - {WINDOW} + 2)) AS i FROM cand)),
        hot AS (SELECT doc_id, k, kind, a, min(i) - 1 AS lo, max(i) - 1 + {WINDOW} AS hi FROM win
            WHERE list_sum(list_transform(list_distinct(w), lambda x: ({terms})[len(list_filter(w, lambda y: y = x)) + 1])) <= CASE WHEN regexp_matches(s, '{HEX_ONLY}') THEN {most(BITS["hex"])} ELSE {most(BITS["any"])} END
            GROUP BY doc_id, k, kind, s, a),
        spans AS (SELECT doc_id, k, kind, a, a + length(s) AS b FROM base UNION ALL SELECT doc_id, k, kind, a + lo, a + hi FROM hot),
        per AS (SELECT doc_id, count(*) FILTER (k = 0) AS n0, count(*) FILTER (k = 1) AS n1, count(*) FILTER (k = 2) AS n2, count(*) FILTER (k = 3) AS n3,
            string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k, b) FILTER (k < 3) AS base, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k, b) AS every FROM spans GROUP BY doc_id)
        SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(n3, 0) AS n_entropy, coalesce(every, '') AS spans
        FROM d LEFT JOIN per USING (doc_id)"""
