"""Personal data by bootstrapped contextual extraction, with Spark expressions only.

Seeds are the spans of four fixed patterns (email, ip, card, phone) and keys: hexadecimal runs of 32 or more with digits
and letters. Every seed and every identifier-like token (a run of 8 or more ASCII letters and digits with a digit in it)
is a mention; the one or two words left of it are its lexical patterns. Mentions make a graph of patterns and instances
(the mentions' strings). In rounds, a pattern's confidence is the sum of its instances' scores over their number plus
DAMPING, and an instance's score is DECAY times that of its best pattern; seeds keep 1. Scores only rise, and the rounds
end when none rises by TOLERANCE. Patterns that end with high confidence over enough distinct instances discover: the
identifier-like tokens they precede become spans of kind `id`, as keys are. Base spans stay as they are.

A match's place comes from the lengths of the pieces that splitting at the pattern leaves, summed chunk by chunk. Parts
of a text are read from its blocks of BLOCK characters. So a text of many spans takes time in proportion to its length
(save where single words are thousands of characters long: their mentions' left words are as long).

The patterns are written so that Java's engine needs no backtracking into what it has read (possessive, anchored at the
start of a run); they match the same spans as the plain forms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fossilframe.llm.common import drop_stored, ranged_scan, stored

#: kind -> (pattern for Java, a string that a text with a match must hold, if there is one)
PATTERNS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}", "."),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", None),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
}
TOKEN = r"(?<![A-Za-z0-9])(?=[A-Za-z]*+[0-9])[A-Za-z0-9]{8,}+(?![A-Za-z0-9])"
KEY = "(?=[a-fA-F]*+[0-9])(?=[0-9]*+[a-fA-F])[0-9a-fA-F]{32,}"
KINDS = (*PATTERNS, "id")
CONFIDENCE, SUPPORT, DAMPING, DECAY, TOLERANCE = 0.75, 5, 1.0, 0.8, 0.005
#: Characters looked at first for the two words on the left of a mention; where they do not hold both, more and at last all
#: of the text is. Characters of a block, and numbers of a chunk.
NEAR, BLOCK, CHUNK = 200, 4096, 128
SPAN = "struct<s:int,e:int,m:string>"
TWO = r"\S++\s++\S++\s*+\z"


def let(body: str, **values: str) -> str:
    """`body` with names for arrays that it reads by place. Each is worked out once: as a column it could be put into the
    body's lambda, to be worked out for each place."""
    for name, value in values.items():
        body = f"transform(array({value}), {name} -> {body})[0]"
    return body


def part(begin: str, size: str) -> str:
    """The characters of a text, given as `blocks`, from `begin` (0: the first) on."""
    blocks = f"slice(blocks, ({begin}) DIV {BLOCK} + 1, ({begin} + {size} - 1) DIV {BLOCK} - ({begin}) DIV {BLOCK} + 1)"
    return f"CASE WHEN {size} <= 0 THEN '' ELSE substr(array_join({blocks}, ''), CAST(({begin}) % {BLOCK} AS INT) + 1, CAST({size} AS INT)) END"


def with_running(d: DataFrame, numbers: str, zero: str, step: str, out: str) -> DataFrame:
    """Adds `out`: what `step` of (a, x) makes, from `zero` on, of the numbers before each (null where there are none)."""
    chunk = f"slice(numbers, CAST(c * {CHUNK} + 1 AS INT), {CHUNK})"
    chunks = f"sequence(0, (size(numbers) - 1) DIV {CHUNK})"
    listed = "named_struct('a', {a}, 'o', CAST(array() AS array<int>))"
    # what each chunk starts from, then what each number of a chunk starts from
    starts = f"aggregate({chunks}, {listed.format(a=zero)}, (z, c) -> named_struct('a', aggregate({chunk}, z.a, {step}), 'o', array_append(z.o, z.a)), z -> z.o)"
    inner = f"aggregate({chunk}, {listed.format(a='starts[c]')}, (z, y) -> named_struct('a', aggregate(array(y), z.a, {step}), 'o', array_append(z.o, z.a)), z -> z.o)"
    return d.withColumn(out, F.expr(f"CASE WHEN size({numbers}) > 0 THEN {let(f'flatten(transform({chunks}, c -> {inner}))', starts=starts, numbers=numbers)} END"))


def with_blocks(d: DataFrame, needed: str) -> DataFrame:
    return d.withColumn("_blocks", F.expr(f"CASE WHEN {needed} THEN regexp_extract_all(text, '(?s).{{1,{BLOCK}}}', 0) END"))


def located(d: DataFrame, pattern: str, needs: str | None, out: str) -> DataFrame:
    """Adds `out`: array of (start, end, match) of the pattern's matches in column `text`."""
    lit = "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"
    guard = f"contains(text, '{needs}')" if needs else "true"
    d = d.withColumn("_m", F.expr(f"CASE WHEN {guard} THEN regexp_extract_all(text, {lit}, 0) END"))
    d = d.withColumn("_p", F.expr(f"CASE WHEN size(_m) > 0 THEN transform(split(text, {lit}, -1), x -> length(x)) END"))
    d = d.withColumn("_l", F.expr("CASE WHEN size(_m) > 0 THEN " + let("transform(_m, (m, i) -> length(m) + p[i])", p="_p") + " END"))
    d = with_running(d, "_l", "0", "(a, x) -> a + x", "_at")
    spans = let("transform(_m, (m, i) -> named_struct('s', at[i] + p[i], 'e', at[i] + l[i], 'm', m))", at="_at", p="_p", l="_l")
    return d.withColumn(out, F.expr(f"CASE WHEN size(_m) > 0 THEN {spans} ELSE CAST(array() AS array<{SPAN}>) END")).drop("_m", "_p", "_l", "_at")


def with_left(kind: str) -> str:
    """The spans of a kind, each with the last two words before it (all of the text before, where there are fewer)."""
    two = TWO.replace("\\", "\\\\")
    reach = [f"regexp_extract({part(f'greatest(0, x.s - {n})', f'least(x.s, {n})')}, '\\\\s({two})', 1)" for n in (NEAR, 2 * BLOCK)]
    whole = f"regexp_extract({part('0', 'x.s')}, '(?<!\\\\S)({two})', 1)"
    left = "CASE WHEN x.s = 0 THEN '' " + " ".join(f"WHEN {r} <> '' THEN {r}" for r in (*reach, whole)) + f" ELSE {part('0', 'x.s')} END"
    return let(f"transform({kind}, x -> named_struct('s', x.s, 'e', x.e, 'm', x.m, 'l', {left}))", blocks="_blocks")


def _valid(kind: str) -> str:
    digits = "regexp_replace(x.m, '[^0-9]', '')"
    if kind == "ip":
        part = "trim(LEADING '0' FROM p)"
        return f"forall(split(x.m, '[.]'), p -> length({part}) <= 3 AND coalesce(try_cast({part} AS int), 0) <= 255)"
    if kind == "phone":
        return f"length({digits}) BETWEEN 8 AND 15"
    if kind == "card":
        digit = f"CAST(substr(q, length(q) - i + 1, 1) AS int)"
        twice = f"CASE WHEN i % 2 = 1 THEN {digit} WHEN {digit} > 4 THEN 2 * {digit} - 9 ELSE 2 * {digit} END"
        luhn = f"get(transform(array({digits}), q -> aggregate(sequence(1, length(q)), 0, (a, i) -> a + {twice}) % 10 = 0), 0)"
        return f"CASE WHEN length(x.m) BETWEEN 16 AND 37 AND length({digits}) BETWEEN 16 AND 19 THEN {luhn} ELSE false END"
    return "true"


def base_spans(d: DataFrame, keep_text: bool = False) -> DataFrame:
    """Adds a column of spans for each kind of PATTERNS and `token`: identifier-like tokens that overlap no base span.

    The result is stored: what reads it must not take these expressions into its own.
    """
    for kind, (pattern, needs) in PATTERNS.items():
        d = located(d, pattern, needs, kind)
        d = d.withColumn(kind, F.expr(f"filter({kind}, x -> {_valid(kind)})"))
    d = located(d, TOKEN, None, "token")
    # In order of starts: a token overlaps a base span before it if one reaches beyond its start, or the span right after.
    both = ", ".join([*(f"transform({k}, x -> named_struct('s', x.s, 'b', x.e, 'i', -1))" for k in PATTERNS), "transform(token, (x, i) -> named_struct('s', x.s, 'b', 0, 'i', i))"])
    base = " + ".join(f"size({k})" for k in PATTERNS)
    d = d.withColumn("_all", F.expr(f"CASE WHEN size(token) > 0 AND {base} > 0 THEN sort_array(concat({both})) END"))
    d = d.withColumn("_ends", F.expr("transform(_all, x -> x.b)"))
    d = with_running(d, "_ends", "0", "(a, x) -> greatest(a, x)", "_reach")
    free = "filter(transform(every, (x, k) -> CASE WHEN x.i >= 0 AND reach[k] <= x.s AND coalesce(get(every, k + 1).s >= tokens[x.i].e, true) THEN x.i END), i -> i IS NOT NULL)"
    kept = let(f"transform({free}, i -> tokens[i])", every="_all", reach="_reach", tokens="token")
    d = d.withColumn("token", F.expr(f"CASE WHEN _all IS NULL THEN token ELSE {kept} END")).drop("_all", "_ends", "_reach")
    d = with_blocks(d, f"{base} + size(token) > 0")
    d = d.withColumns({k: F.expr(with_left(k)) for k in (*PATTERNS, "token")}).drop("_blocks")
    return stored(d if keep_text else d.drop("text"))


def mentions(found: DataFrame) -> DataFrame:
    """uid, s, e, instance, seed, pattern: a row for each mention and each of its patterns (one and two words on its left)."""
    seeds = F.flatten(F.array(*[F.transform(F.col(k), lambda x: F.struct(x["s"], x["e"], x["m"], x["l"], F.lit(True).alias("seed"))) for k in PATTERNS]))
    other = F.transform("token", lambda x: F.struct(x["s"], x["e"], x["m"], x["l"], x["m"].rlike(f"^{KEY}$").alias("seed")))
    m = found.filter(F.expr(" + ".join(f"size({k})" for k in (*PATTERNS, "token"))) > 0).select("uid", F.explode(F.concat(seeds, other)).alias("x"))
    left = F.lower(F.col("x.l"))
    one, two = F.regexp_extract(left, r"(\S+\s*)$", 1), F.regexp_extract(left, r"(\S+\s+\S+\s*)$", 1)
    patterns = F.filter(F.array_distinct(F.transform(F.array(one, two), lambda c: F.regexp_replace(c, r"\s+", " "))), lambda c: F.length(F.trim(c)) > 0)
    m = m.select("uid", "x.s", "x.e", F.lower("x.m").alias("instance"), "x.seed", F.explode(patterns).alias("pattern"))
    return m


def confident_patterns(m: DataFrame, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """pattern, score, instances: those with at least this score and this many distinct instances."""
    edges = stored(m.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")))
    first = edges.groupBy("instance").agg(F.max("seed").cast("double").alias("score"))
    patterns = None
    while True:
        if patterns is None:
            scores = first
        else:
            known = patterns.filter(F.col("instances") >= support).select("pattern", F.col("score").alias("p"))
            best = edges.join(known, "pattern", "left")
            scores = best.groupBy("instance").agg(F.max(F.when(F.col("seed"), 1.0).otherwise(F.lit(DECAY) * F.coalesce("p", F.lit(0.0)))).alias("score"))
        seeded = edges.groupBy("instance").agg(F.max("seed").alias("is_seed"))
        scores = scores.join(seeded, "instance").select("instance", F.when(F.col("is_seed"), 1.0).otherwise(F.col("score")).alias("score"))
        new = edges.join(scores, "instance").groupBy("pattern").agg((F.sum("score") / (F.count("*") + F.lit(DAMPING))).alias("score"), F.count("*").alias("instances"))
        if patterns is not None:
            new = new.join(patterns.select("pattern", F.col("score").alias("before")), "pattern")
            new = stored(new)
            rise = new.agg(F.max(F.col("score") - F.col("before"))).first()[0] or 0.0
            drop_stored(patterns)
        else:
            new, rise = stored(new.withColumn("before", F.lit(0.0))), 1.0
        patterns = new
        if rise < TOLERANCE or patterns.isEmpty():
            return patterns.filter((F.col("score") >= confidence) & (F.col("instances") >= support)).select("pattern", "score", "instances")


def discovered(found: DataFrame, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """uid, id: the spans that confident patterns discover, and keys, as one array for each text that has any."""
    m = stored(mentions(found))
    confident = confident_patterns(m, confidence, support).select("pattern")
    hit = m.filter("NOT seed").join(confident, "pattern", "left_semi").select("uid", "s", "e")
    keys = found.select("uid", F.explode(F.filter("token", lambda x: x["m"].rlike(f"^{KEY}$"))).alias("x")).select("uid", "x.s", "x.e")
    return hit.unionByName(keys).distinct().groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("id"))


def joined(kinds: tuple[str, ...]) -> Column:
    """The spans as kind:start:end, by kind as listed, then start, joined by commas."""

    def written(kind: str) -> Column:
        return F.transform(F.col(kind), lambda x: F.concat(F.lit(f"{kind}:"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string")))

    return F.array_join(F.concat(*map(written, kinds)), ",")


def find_private(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_id, n_spans (of all kinds) of every document.

    Null or empty text has no spans (the digest is that of the empty string). Repeated rows stay repeated, each with its
    spans. Places are code points, the end exclusive.
    """
    d = ranged_scan(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = base_spans(d.withColumn("uid", F.monotonically_increasing_id()))
    d = found.drop("token").join(discovered(found), "uid", "left").withColumn("id", F.coalesce("id", F.expr("CAST(array() AS array<struct<s:int,e:int>>)")))
    return d.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in PATTERNS],
        F.sha2(joined(tuple(PATTERNS)), 256).alias("base_sha256"),
        joined(KINDS).alias("spans"),
        F.size("id").cast("long").alias("n_id"),
        sum((F.size(k) for k in KINDS), F.lit(0)).cast("long").alias("n_spans"),
    )


def mask_private(docs: DataFrame) -> DataFrame:
    """docs with each personal span in `text` replaced by its kind in brackets; all else as it was.

    Overlapping spans are masked as one, under the kind that starts first. Texts without spans, and null, are unchanged.
    """
    cols = docs.columns
    d = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)], F.col("text")).withColumn("uid", F.monotonically_increasing_id())
    found = base_spans(d, True)
    some = F.expr(" + ".join(f"size({k})" for k in PATTERNS) + " + size(token)") > 0
    back = [F.col(f"c{i}").alias(c) for i, c in enumerate(cols)]
    plain = found.filter(~F.coalesce(some, F.lit(False))).select(*back)
    d = found.filter(some).join(discovered(found), "uid", "left").withColumn("id", F.coalesce("id", F.expr("CAST(array() AS array<struct<s:int,e:int>>)")))

    def placed(kind: str) -> Column:
        return F.transform(F.col(kind), lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("e"), F.lit(kind).alias("k")))

    d = with_blocks(d, "true")
    # In order of starts, a span that starts before the reach of those before it is masked with them.
    d = d.withColumn("_spans", F.sort_array(F.concat(*map(placed, KINDS)))).withColumn("_ends", F.expr("transform(_spans, x -> -x.e)"))
    d = with_running(d, "_ends", "0", "(a, x) -> greatest(a, x)", "_reach")
    pieces = f"array_join(transform(_spans, (x, i) -> CASE WHEN x.s >= reach[i] THEN concat({part('reach[i]', '(x.s - reach[i])')}, '[', upper(x.k), ']') ELSE '' END), '')"
    masked = let(f"concat({pieces}, {part('_end', '(length(text) - _end)')})", reach="_reach", blocks="_blocks")
    d = d.withColumn("_end", F.expr("coalesce(array_max(_ends), 0)"))
    d = d.withColumn("_masked", F.expr(f"CASE WHEN size(_spans) > 0 THEN {masked} ELSE text END"))
    masked = d.select(*[F.col("_masked").alias(c) if c == "text" else F.col(f"c{i}").alias(c) for i, c in enumerate(cols)])
    return plain.unionByName(masked)
