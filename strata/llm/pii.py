"""Personal data: fixed patterns, and bootstrapped contextual extraction.

Four kinds are found by regular expression and checked (addresses by their
parts, cards by their check digit, phones by their digits).  Seeds of the bootstrap
are these finds and tokens of the shape of a key (``KEY``: long hexadecimal, or
long with small and capital letters and digits).  Any other token that holds a
digit or an @, groups of digits behind it included, is an instance without a seed.

The one, two and three words or signs beside an instance, on either side and on
its line, are its lexical patterns (a word with digits stands as 0).  Patterns and
instances form a graph, scored in rounds: a pattern's confidence is the score of
its distinct instances over their number and one, and counts from ``LEAST`` seeds
in two documents on, more for shorter patterns.  An instance's score is the chance
that its best confident pattern on one of the sides is right.  Rounds go on until
one adds no confident pattern; scores never fall, so they end.  Of the patterns so
found, those stay that have an instance beside them in most of all the places where
their words stand in the texts ("token =" does, "of the" does not), and the rounds
run again with these alone.

In the end each mention is judged on each side by its longest pattern that enough
instances share; a longer one without seeds overrules a shorter one with seeds.
Mentions in confident contexts, key-shaped or not, become finds of the kind
``found``; a key-shaped token elsewhere does not.

Everything is a DataFrame function.  Spark has no function for the positions of
matches, so the text between matches (split) and the matches are taken side by
side, and positions are running sums of their lengths.  The expressions are
written with possessive quantifiers and anchored so that no start is tried twice,
which gives the same matches in time linear in the text and without recursion.

Scale: two scans of the texts; what moves are matches with a few words around
them, and counts of the confident patterns.  These are broadcast to the second scan
up to ``SENT`` of them; beyond, counts of all strings of up to three words are
merged and joined.  Graph edges are merged before they are scored, so a very common pattern or
instance is pre-aggregated, and the joins carry single rows that the engine can
split.  Words and instances of more than ``LONG`` characters stand as digests in
the graph.  Scores are written to the shared folder after each round.

Cases: a null text counts as empty, and has no spans.  Rows equal in all columns
get equal results.  Empty tables give empty results.  Very long texts and words
are read whole.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.spark import discard, materialize, read_texts

KINDS = ("email", "ip", "card", "phone", "found")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "token": r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?:\x20[(]?[0-9][0-9().-]*+(?!\S))*+",
}
#: What a text must hold for the pattern to be tried.
GATES = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "token": r"[0-9@]"}

#: Shapes of keys: hexadecimal of 32 to 128 signs with letters and digits, or 20
#: to 200 letters of both cases and digits.
KEY = (
    r"^(?=[0-9]*+[A-Fa-f])(?=[A-Fa-f]*+[0-9])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})$"
    r"|^(?=[^a-z]*+[a-z])(?=[^A-Z]*+[A-Z])(?=[^0-9]*+[0-9])[A-Za-z0-9_+/-]{20,200}={0,2}$"
)
#: Seeds that a pattern of one, two or three words needs.
LEAST = (8, 3, 2)
LEAST_SEEDS, CONFIDENT, SPECIFIC, LONG, SENT = 2, 0.5, 0.5, 64, 100_000
#: Up to three words or signs from the start of a line's rest, and one of them.
CONTEXT = r"^(?:[^\S\n]*+(?:[\p{L}\p{N}_]++|[^\s\p{L}\p{N}_])){0,3}+"
WORD = r"[\p{L}\p{N}_]++|[^\s\p{L}\p{N}_]"
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})){3}$"


def luhn(digits: Column) -> Column:
    def doubled(x: Column, i: Column) -> Column:
        n = x.cast("int") * (i % 2 + 1)
        return F.when(n > 9, n - 9).otherwise(n)

    each = F.transform(F.split(F.reverse(digits), ""), doubled)
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: Column, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    return (
        F.when(kind == "ip", match.rlike(OCTETS))
        .when(kind == "card", F.when(n.between(14, 19), luhn(digits)).otherwise(F.lit(False)))
        .when(kind == "phone", n.between(10, 15))
        .otherwise(F.lit(True))
    )


def matches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, row, kind, k, copies, start, end, match, before, behind): the k-th match
    of each pattern, checked or not, with up to three words on either side.  A match
    of the same pattern among them stands as 0.  Of ``copies`` equal rows one stays."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(id_col, text_col).alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    tried = F.array(*(
        F.when(F.col("text").rlike(GATES[kind]), F.struct(F.lit(kind).alias("kind"), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("matches"), F.split("text", pattern, -1).alias("gaps")))
        for kind, pattern in PATTERNS.items()
    ))
    found = rows.select("id", "row", F.explode(tried).alias("t")).filter(F.size("t.matches") > 0)

    def side(m: Column, i: Column) -> Column:
        gap, after = F.get("t.gaps", i), F.get("t.gaps", i + 1)
        left = F.concat(F.when(i > 0, "0 ").otherwise(""), gap)
        right = F.concat(after, F.when(i + 1 < F.size("t.matches"), " 0").otherwise(""))
        before = F.reverse(F.regexp_extract(F.reverse(left), CONTEXT, 0))
        return F.struct(i.alias("k"), m.alias("match"), F.length(gap).alias("gap"), before.alias("before"), F.regexp_extract(right, CONTEXT, 0).alias("behind"))

    each = found.select("id", "row", "t.kind", F.explode(F.transform("t.matches", side)).alias("m")).select("id", "row", "kind", "m.k", "m")
    # rows equal in all columns have equal matches
    once = each.repartition("id", "row").groupBy("id", "row", "kind", "k").agg(F.first("m").alias("m"), F.count(F.lit(1)).alias("copies"))
    once = once.select("id", "row", "kind", "k", "copies", "m.gap", "m.match", "m.before", "m.behind")
    so_far = Window.partitionBy("id", "row", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("match")).over(so_far)
    return once.select("id", "row", "kind", "k", "copies", (end - F.length("match")).alias("start"), end.alias("end"), "match", "before", "behind")


def _short(c: Column) -> Column:
    return F.when(F.length(c) > LONG, F.sha2(c, 256)).otherwise(c)


def _plain(word: Column) -> Column:
    return F.when(word.rlike("[0-9]"), "0").otherwise(_short(word))


def _patterns(before: Column, behind: Column) -> Column:
    """(pattern, context): L1, L2, L3 and R1, R2, R3 with the words nearest to the
    instance, and the longest on the same side."""
    left, right = (F.transform(F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0)), _plain) for c in (before, behind))
    sizes = range(1, len(LEAST) + 1)
    sides = [
        [F.when(F.size(left) >= n, F.concat(F.lit(f"L{n} "), F.array_join(F.slice(left, -n, n), " "))) for n in sizes],
        [F.when(F.size(right) >= n, F.concat(F.lit(f"R{n} "), F.array_join(F.slice(right, 1, n), " "))) for n in sizes],
    ]
    made = [F.struct(p.alias("pattern"), F.coalesce(*reversed(side)).alias("context")) for side in sides for p in side]
    return F.filter(F.array(*made), lambda x: x["pattern"].isNotNull())


def _size(pattern: Column) -> Column:
    return F.coalesce(F.substring(pattern, 2, 1).try_cast("int"), F.lit(0))


def needed(pattern: Column) -> Column:
    """The seeds that a pattern needs, by its number of words."""
    return F.element_at(F.array(*(F.lit(float(n)) for n in LEAST)), _size(pattern))


def mentions(found: DataFrame, base: DataFrame) -> DataFrame:
    """(id, row, copies, start, end, match, instance, checked, seed, pattern, context)
    for every pattern that a checked find, or a token that overlaps none, stands in."""
    seeds = base.select("id", "row", "copies", "start", "end", "match", F.lit(True).alias("checked"), "before", "behind")
    lead = F.regexp_extract("match", r"^[^\p{L}\p{N}@+]*+", 0)
    core = F.regexp_extract("match", r"[\p{L}\p{N}@+](?:.*[\p{L}\p{N}])?+", 0)
    tokens = found.filter(F.col("kind") == "token").withColumns({"lead": lead, "core": core}).filter(F.length("core") > 0)
    tail = F.substring("match", F.length("lead") + F.length("core") + 1, F.length("match"))
    start = F.col("start") + F.length("lead")
    others = tokens.select("id", "row", "copies", start.alias("start"), (start + F.length("core")).alias("end"), F.col("core").alias("match"), F.lit(False).alias("checked"), F.concat("before", F.lit(" "), "lead").alias("before"), F.concat(tail, F.lit(" "), "behind").alias("behind"))
    # a token overlaps a find that begins before it and ends behind its start, or begins within it
    rows, up, down = Window.partitionBy("id", "row"), (F.col("start"), F.col("end")), (F.col("start").desc(), F.col("end").desc())
    reach = F.max(F.when(F.col("checked"), F.col("end"))).over(rows.orderBy(*up).rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.min(F.when(F.col("checked"), F.col("start"))).over(rows.orderBy(*down).rowsBetween(Window.unboundedPreceding, -1))
    placed = seeds.unionByName(others).withColumn("reach", reach).withColumn("ahead", ahead)
    free = placed.filter(F.col("checked") | ~(F.coalesce(F.col("reach") > F.col("start"), F.lit(False)) | F.coalesce(F.col("ahead") < F.col("end"), F.lit(False))))
    seed = (F.col("checked") | F.col("match").rlike(KEY)).cast("double")
    return free.select("id", "row", "copies", "start", "end", "match", _short(F.col("match")).alias("instance"), "checked", seed.alias("seed"), F.inline(_patterns(F.col("before"), F.col("behind"))))


def _scored(edges: DataFrame, scores: DataFrame) -> DataFrame:
    """(pattern, total, n): the score and number of each pattern's instances."""
    return edges.join(scores, "instance", "left").groupBy("pattern").agg(F.sum(F.coalesce("score", F.lit(0.0))).alias("total"), F.count(F.lit(1)).alias("n"))


def _judged(edges: DataFrame, scores: DataFrame, least: Column | int, among: DataFrame | None) -> DataFrame:
    """(pattern, confidence) of the patterns that enough instances share; none for
    those not ``among`` the given ones."""
    least = least if isinstance(least, Column) else F.lit(least)
    scored = _scored(edges, scores).filter(F.col("n") >= least)
    able = F.col("total") >= least
    if among is not None:
        scored, able = scored.join(among.select("pattern", F.lit(True).alias("able")), "pattern", "left"), able & F.col("able").isNotNull()
    return scored.select("pattern", F.when(able, F.col("total") / (F.col("n") + 1)).otherwise(F.lit(0.0)).alias("confidence"))


def _best(links: DataFrame, judged: DataFrame, *keys: str) -> DataFrame:
    """The confidence of the longest judged pattern of each context."""
    known = F.when(F.col("confidence").isNotNull(), _size(F.col("pattern")))
    return links.join(judged, "pattern", "left").groupBy(*keys, "context").agg(F.coalesce(F.max_by("confidence", known), F.lit(0.0)).alias("confidence"))


def _rounds(edges: DataFrame, links: DataFrame, least: Column | int, bound: float, among: DataFrame | None = None) -> DataFrame:
    """The patterns, judged by scores that no round raises any more."""
    seeds = edges.groupBy("instance").agg(F.max("seed").alias("score")).filter("score > 0")
    scores = seeds
    held, last, judged, written = -1, None, None, None
    while True:
        judged, last = materialize(_judged(edges, scores, least, among), "patterns"), judged
        now = judged.filter(F.col("confidence") >= bound).count()
        for old in (last, written):
            if old is not None:
                discard(old)
        if now <= held or not now:
            return judged
        held = now
        right = F.when(F.col("confidence") >= bound, F.col("confidence")).otherwise(0.0)
        side = _best(links, judged, "instance").groupBy("instance", F.substring("context", 1, 1)).agg(F.max(right).alias("best"))
        new = side.groupBy("instance").agg((1 - F.exp(F.sum(F.log1p(-F.col("best"))))).alias("score")).filter("score > 0")
        scores = written = materialize(seeds.unionByName(new).groupBy("instance").agg(F.max("score").alias("score")), "scores")


def _places(docs: DataFrame, text_col: str, words: DataFrame) -> DataFrame:
    """(words, places): how often each of ``words`` stands in the texts, on a line."""
    text = F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    each = docs.select(F.regexp_extract_all(text, F.lit(WORD + r"|\n"), F.lit(0)).alias("w")).filter(F.size("w") > 0)
    three = each.select(F.inline(F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.size("w")).alias("b"), F.slice("w", 3, F.size("w")).alias("c")))).filter("a <> '\n'")
    a, b, c = (F.when(F.col(x) != "\n", _plain(F.col(x))) for x in "abc")
    all_words = three.select(a.alias("a"), b.alias("b"), c.alias("c")).select(F.explode(F.array("a", F.concat("a", F.lit(" "), "b"), F.concat("a", F.lit(" "), "b", F.lit(" "), "c"))).alias("words")).filter("words is not null")
    count = F.count(F.lit(1)).alias("places")
    if words.count() <= SENT:
        return all_words.join(F.broadcast(words), "words", "left_semi").groupBy("words").agg(count)
    return all_words.groupBy("words").agg(count).join(words, "words", "left_semi")


def specific(docs: DataFrame, text_col: str, seen: DataFrame, patterns: DataFrame, bound: float = SPECIFIC) -> DataFrame:
    """Those of ``patterns`` that mostly stand beside an instance."""
    words = F.substring("pattern", 4, 1 << 30).alias("words")
    filled = seen.join(patterns.select("pattern"), "pattern").groupBy("pattern").agg(F.sum("copies").alias("filled"))
    places = _places(docs, text_col, patterns.select(words).distinct())
    both = filled.withColumn("words", words).join(places, "words", "left")
    return both.filter(F.coalesce(F.col("filled") >= bound * F.col("places"), F.lit(True))).select("pattern")


def confident(edges: DataFrame, least: Column | int = LEAST_SEEDS, bound: float = CONFIDENT) -> DataFrame:
    """(pattern, confidence) of the patterns that the rounds settle on.

    ``edges`` holds (pattern, instance, seed) once for each pair, and each pattern
    stands alone.
    """
    return _rounds(edges, edges.withColumn("context", F.col("pattern")), least, bound).filter(F.col("confidence") >= bound)


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, kind, start, end, match) of every find, in code points."""
    found = materialize(matches(docs, id_col, text_col), "matches")
    base = found.filter((F.col("kind") != "token") & valid(F.col("kind"), F.col("match")))
    seen = materialize(mentions(found, base), "mentions")
    rows = F.xxhash64("id", "row")
    edges = seen.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"), F.min(rows).alias("low"), F.max(rows).alias("high"))
    wide = materialize(edges.groupBy("pattern").agg(F.min("low").alias("low"), F.max("high").alias("high")).filter("low <> high").select("pattern"), "wide")
    edges = materialize(edges.select("pattern", "instance", "seed").join(wide, "pattern"), "edges")
    links = materialize(seen.select("pattern", "context", "instance").join(wide, "pattern", "left_semi").distinct(), "links")
    least = needed(F.col("pattern"))
    able = _rounds(edges, links, least, CONFIDENT).filter(F.col("confidence") >= CONFIDENT)
    judged = _rounds(edges, links, least, CONFIDENT, materialize(specific(docs, text_col, seen, able), "specific"))
    place = ("id", "row", "start", "end", "match")
    new = _best(seen.filter(~F.col("checked")), judged, *place).filter(F.col("confidence") >= CONFIDENT).select(*place, F.lit("found").alias("kind")).distinct()
    return base.select("id", "row", "kind", "start", "end", "match").unionByName(new)


def by_document(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and span lists of every document, and whether it has any span."""
    rank = F.array_position(F.array(*(F.lit(k) for k in KINDS)), F.col("kind"))
    counts = [F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in KINDS]
    spans = F.sort_array(F.collect_list(F.struct("start", rank.alias("rank"), "kind", "end"))).alias("all_spans")
    grouped = extract(docs, id_col, text_col).groupBy("id", "row").agg(*counts, spans).withColumnsRenamed({"id": "of_id", "row": "of_row"})
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(id_col, text_col).alias("row"))
    joined = rows.join(grouped, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("row") == F.col("of_row")), "left")

    def listed(spans: Column) -> Column:
        return F.coalesce(F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","), F.lit(""))

    base = listed(F.filter("all_spans", lambda s: s["kind"] != "found"))
    counted = {k: F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS}
    return joined.select("doc_id", *(counted[k] for k in KINDS), F.sha2(base, 256).alias("base_sha256"), listed(F.col("all_spans")).alias("spans"), F.col("all_spans").isNotNull().alias("private"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: personal data in every document."""
    return by_document(read_texts(spark, sf_dir, "documents"))
