"""Line dedup by a segment-partition edit join (operator 10, DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table, text_or_empty, written

#: Default of the functions below: lines of fewer characters are left alone.
MIN_CHARS = 32
#: The queries look at all lines but blank ones (white space only): equal lines of any length go.
ALL_LINES = 1
#: White space: a line of nothing else is blank.
BLANKS = " \t\n\x0b\f\r"
#: Shortest line at which one edit still means a near copy; shorter ones are compared by hash alone.
NEAR_CHARS = 16
#: Shortest line with the full number of edits; from NEAR_CHARS up to here it is one at most.
LONG_CHARS = 32
#: Lines are near if so many character edits or fewer turn one into the other (see LONG_CHARS).
EDITS = 3
SALTS = 4
#: Lines of a key that more rows share are not paired yet: what is left of them is cut into segments anew, up to LEVELS cuts.
HOT, LEVELS = 64, 2
#: Words of 64 bits of the filter that spares most lines' texts the shuffle of candidates. It may let more pass, never fewer.
FILTER_WORDS = 1 << 16
#: Characters whose counts, apart by more than two an edit, tell that two lines are not near (any choice is exact).
COUNTED = ("etaoinsrdlhuc", "mfpgwybvkxzqj")
#: What a row of a line carries to tell near lines from others: its length and a word for each group of those counts.
CARRIED = ("n", "c0", "c1")
#: Four bits for each count modulo eight, of which one changes when the count does by one.
WHEEL = 0x8CEF7310


# --- lines and their order -----------------------------------------------------------------------


def document_key() -> tuple[Column, Column]:
    """(order, text hash) of a row: order is doc_id; rows without one come behind all others, by a hash of their text."""
    h = F.xxhash64(text_or_empty())
    behind = F.lit(1 << 62) + h.bitwiseAND(F.lit((1 << 61) - 1))
    return F.coalesce(F.col("doc_id").cast("long"), behind), h


def occurrences(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """did, th (document key), pos, line, n, h1, h2 of every line of min_chars or more that is not blank."""
    did, th = document_key()
    lines = docs.select(did.alias("did"), th.alias("th"), F.posexplode(F.split(text_or_empty(), "\n")).alias("pos", "line"))
    lines = lines.withColumn("n", F.char_length("line")).where((F.col("n") >= min_chars) & (F.ltrim("line", F.lit(BLANKS)) != ""))
    return lines.withColumn("h1", F.xxhash64("line")).withColumn("h2", F.xxhash64(F.lit(1), "line"))


def place() -> Column:
    """The place of a line in the corpus as one number: document, 32 bits of its text's hash, position."""
    inner = F.col("th").bitwiseAND(F.lit((1 << 32) - 1)) * F.lit(1 << 31) + F.col("pos")
    return (F.col("did").cast("decimal(19,0)") * F.lit(Decimal(1 << 63)).cast("decimal(19,0)") + inner.cast("decimal(19,0)")).cast("decimal(38,0)")


# --- segments ------------------------------------------------------------------------------------


def shapes(edits: int) -> list[tuple[int, int]]:
    """(segment, shift) of the substrings that are looked up: first the edits + 1 segments in place, then moved ones.

    Of edits + 1 parts with `edits` edits in all, take the first part i whose edits and those before
    it are i at most: it is whole, i edits are left of it and edits - i right of it at most. So a
    segment counted from the left is moved by i at most, one counted from the right by edits - i.
    """
    reach = [min(i, edits - i) for i in range(edits + 1)]
    return [(i, 0) for i in range(edits + 1)] + [(i, d) for i, r in enumerate(reach) for d in range(-r, r + 1) if d]


def _left(i: int, edits: int) -> bool:
    return i <= edits - i


def _beside(i: int, edits: int) -> int:
    """Edits at most in what _rest keeps beside segment i (see shapes): right of one counted from the left, left of the others."""
    return edits - i if _left(i, edits) else i


def segment_size(n: Column, edits: int) -> Column:
    """Characters of a segment of a line of n: alike for all lengths of a class, of which an octave has four."""
    step = F.call_function("shiftleft", F.lit(1), F.greatest(F.floor(F.log2(F.greatest(n, F.lit(1)))).cast("int") - 2, F.lit(0)))
    return F.floor((n - n % step) / (edits + 1)).cast("int")


def _start(n: Column, size: Column, i: int, shift: int, edits: int) -> Column:
    """Where segment i begins (from 0): the first half is counted from the left, the others from the right."""
    return (F.lit(i) * size if _left(i, edits) else n - F.lit(edits + 1 - i) * size) + F.lit(shift)


def _keys(line: Column, n: Column, size: Column, edits: int, *parent: Column) -> list[Column]:
    """A key for each of shapes(edits): parent, segment, its size and its text; null where the line has no such place."""
    out = []
    for i, shift in shapes(edits):
        at = _start(n, size, i, shift, edits)
        out.append(F.when((at >= 0) & (at + size <= n), F.xxhash64(*parent, F.lit(i), size, F.substring(line, at + 1, size))))
    return out


def allowed(n: Column, edits: int = EDITS) -> Column:
    """Edits by which a pair may differ whose shorter line has n characters."""
    return F.when(n >= LONG_CHARS, edits).when(n >= NEAR_CHARS, min(edits, 1)).otherwise(0)


def shorter(n: Column, edits: int, min_chars: int) -> Column:
    """The least length that a line near to one of n characters may have, counting lines of n or fewer."""
    near = F.greatest(n - min(edits, 1), F.lit(max(NEAR_CHARS, min_chars)))
    full = F.when(n - edits >= LONG_CHARS, n - edits).when((n == LONG_CHARS) & (F.lit(min_chars) < LONG_CHARS), n - min(edits, 1)).otherwise(n)
    return F.when(n >= LONG_CHARS, full).otherwise(near)


def _sizes(n: Column, edits: int) -> Column:
    """Segment size of a line of n characters, null for lines that are not looked up by segments."""
    return F.when(n >= LONG_CHARS, segment_size(n, edits)).when(n >= NEAR_CHARS, segment_size(n, min(edits, 1)))


def line_keys(lines: DataFrame, edits: int, min_chars: int) -> DataFrame:
    """lines(line, n, ...) with k0, k1, ...: a key for each of shapes(edits) by the line's own class, then by that of shorter lines.

    The latter are null where shorter lines are of the same class. Lines below LONG_CHARS have the
    first and the last segment only: halves, as one edit leaves two parts.
    """
    n = F.col("n")
    low = F.when(n >= NEAR_CHARS, shorter(n, edits, min_chars))
    other = (low >= LONG_CHARS) != (n >= LONG_CHARS)
    lines = lines.withColumn("_s0", _sizes(n, edits)).withColumn("_s1", F.when(other | (_sizes(low, edits) != _sizes(n, edits)), _sizes(low, edits)))
    lines = lines.withColumn("_f0", n >= LONG_CHARS).withColumn("_f1", low >= LONG_CHARS)
    # One expression for all shapes: written out for each, the generated code is too long to be compiled well.
    at = lambda i, d: (i, d, i if _left(i, edits) else i - edits - 1, 0 if _left(i, edits) else 1, i in (0, edits) and not d)
    places = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip("idpqe", at(i, d), strict=True)]) for i, d in shapes(edits)])

    def hashed(size: str, full: str) -> Column:
        start = lambda x: x["p"] * F.col(size) + x["q"] * F.col("n") + x["d"]
        key = lambda x: F.xxhash64(x["i"], F.col(size), F.substring("_u", 4 * start(x) + 1, 4 * F.col(size)))
        return F.when(F.col(size).isNotNull(), F.transform(places, lambda x: F.when(F.col(full) | x["e"], key(x))))

    # Four bytes a character, so that a place is found without a walk over the line.
    lines = lines.withColumn("_u", F.encode("line", "UTF-32"))
    lines = lines.withColumn("_k0", hashed("_s0", "_f0")).withColumn("_k1", hashed("_s1", "_f1"))
    half = len(shapes(edits))
    keys = [F.get(f"_k{j // half}", F.lit(j % half)).alias(f"k{j}") for j in range(2 * half)]
    return lines.select("*", *keys).drop("_s0", "_s1", "_f0", "_f1", "_u", "_k0", "_k1")


def distinct_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """h1, h2, first (place of the earliest occurrence), n (occurrences) and keys k0, k1, ... of every different line.

    Keys are taken where lines are read, so that no line's text is shuffled for them, and equal lines
    are combined before the shuffle.
    """
    keys = [f"k{j}" for j in range(2 * len(shapes(edits)))]
    out = line_keys(occurrences(docs, min_chars), edits, min_chars).select("h1", "h2", place().alias("place"), *keys)
    return out.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"), *[F.max(k).alias(k) for k in keys])


# --- candidates ----------------------------------------------------------------------------------


def live_rows(unique: DataFrame, edits: int = EDITS) -> DataFrame:
    """key, id (h1), code (place in line_keys) of every key that a different line has too, in place on at least one side."""
    rows = unique.select("h1", F.posexplode(F.array(*[f"k{j}" for j in range(2 * len(shapes(edits)))])).alias("code", "key"))
    rows = rows.where("key is not null")
    # Both sides are the same rows under the same names, so that one shuffle serves both.
    two = (F.col("l.key") == F.col("r.key")) & (F.col("l.h1") != F.col("r.h1")) & ((F.col("l.code") <= edits) | (F.col("r.code") <= edits))
    return rows.alias("l").join(rows.alias("r"), two, "left_semi").select("key", F.col("h1").alias("id"), "code")


def _bit(x: Column) -> tuple[Column, Column]:
    """(word, mask) of the place of x in the filter."""
    h = F.xxhash64(x)
    return F.pmod(F.shiftright(h, 6), F.lit(FILTER_WORDS)), F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))


def passing(rows: DataFrame, x: Column, wanted: DataFrame, y: Column) -> DataFrame:
    """rows whose x may be among the y of wanted: none of those is lost, others pass by chance.

    The filter has FILTER_WORDS words of 64 bits whatever the input, so it is broadcast.
    """
    word, mask = _bit(y)
    bits = wanted.select(word.alias("_word"), mask.alias("_mask")).groupBy("_word").agg(F.bit_or("_mask").alias("_bits"))
    at, own = _bit(x)
    held = rows.withColumn("_at", at).withColumn("_own", own)
    return held.join(F.broadcast(bits), (F.col("_at") == F.col("_word")) & (F.col("_bits").bitwiseAND(F.col("_own")) != 0)).select(*rows.columns)


def texts_of(docs: DataFrame, wanted: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """id, h2, first, n, line of the lines in wanted(id, h2, first): each read where it occurs first.

    Other lines' texts are filtered before the shuffle, as far as the filter can tell.
    """
    lines = passing(occurrences(docs, min_chars), F.col("h1"), wanted, F.col("id")).select("line", "n", "h1", place().alias("at"))
    lines = passing(lines, F.col("at"), wanted, F.col("first"))
    return wanted.join(lines, (F.col("first") == F.col("at")) & (F.col("id") == F.col("h1"))).select("id", "h2", "first", "n", "line").dropDuplicates(["id", "h2"])


def _counts(line: Column) -> list[Column]:
    """How often a line has each of these ASCII characters, as bits: an edit changes two of them in all at most."""
    out = []
    for name, group in zip(CARRIED[1:], COUNTED, strict=True):
        bits = F.lit(0).cast("long")
        for at, x in enumerate(group):
            count = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(x), F.lit("")))
            code = F.call_function("shiftrightunsigned", F.lit(WHEEL).cast("long"), count.bitwiseAND(F.lit(7)) * 4).bitwiseAND(F.lit(15).cast("long"))
            bits = bits.bitwiseOR(F.shiftleft(code, 4 * at))
        out.append(bits.alias(name))
    return out


def _rest(rows: DataFrame, texts: DataFrame, edits: int, min_chars: int) -> DataFrame:
    """key, id, mask, a, b, edits, n and counts for live rows(key, id, code): what is right of a segment counted from the left, or left of the others.

    mask has a bit for every level at which the row is a moved substring; a pair needs one side in place at each.
    edits is the number that the parts from a to b of a near pair may be apart, alike for all rows of a key.
    """
    n, half = F.col("n"), len(shapes(edits))
    size = _sizes(F.when(F.col("code") < half, n).otherwise(shorter(n, edits, min_chars)), edits)
    held = rows.join(texts.select("id", "n", *_counts(F.col("line"))), "id").withColumn("size", size)
    a = b = few = F.lit(None).cast("int")
    for j, (i, shift) in enumerate(shapes(edits)):
        here = F.pmod(F.col("code"), F.lit(half)) == j
        at = _start(n, F.col("size"), i, shift, edits)
        a = F.when(here, at + F.col("size") if _left(i, edits) else F.lit(0)).otherwise(a)
        b = F.when(here, n if _left(i, edits) else at).otherwise(b)
        few = F.when(here, _beside(i, edits)).otherwise(few)
    return held.select("key", "id", F.when(F.col("code") <= edits, 0).otherwise(1).alias("mask"), a.alias("a"), b.alias("b"), few.alias("edits"), *CARRIED)


def _again(rows: DataFrame, texts: DataFrame, edits: int, level: int) -> DataFrame:
    """rows(key, id, mask, a, b, edits) with their line's part from a to b cut into segments anew, under their key: one more than its edits."""
    n = F.col("b") - F.col("a")
    part = rows.join(texts.select("id", "line"), "id").select("key", "id", "mask", "a", "b", "edits", *CARRIED, n.alias("size"), F.substring("line", F.col("a") + 1, n).alias("line"))
    found = F.when(F.col("edits") == edits, _parts(edits, level))
    for few in range(edits - 1, 0, -1):
        found = found.when(F.col("edits") == few, _parts(few, level))
    out = part.select("id", *CARRIED, F.explode(F.filter(found, lambda x: x["key"].isNotNull())).alias("x"))
    return out.select("x.key", "id", "x.mask", "x.a", "x.b", "x.edits", *CARRIED)


def _parts(edits: int, level: int) -> Column:
    """Array of (key, mask, a, b, edits) for each of shapes(edits) of a part(line, size) that may be `edits` apart, by its own class and that of shorter parts."""
    n, line, found = F.col("size"), F.col("line"), []
    for own, m in ((True, n), (False, F.greatest(n - edits, F.lit(0)))):
        size = segment_size(m, edits)
        more = F.lit(True) if own else size != segment_size(n, edits)
        keys = _keys(line, n, size, edits, F.col("key"))
        for j, (i, shift) in enumerate(shapes(edits)):
            at = F.col("a") + _start(n, size, i, shift, edits)
            moved = F.lit(0 if own and j <= edits else 1 << level)
            # Too short for segments: one key for all such parts.
            key = F.when(more & (size > 0), keys[j])
            if j == 0:
                key = key.when(more & (size == 0), F.xxhash64(F.col("key"), F.lit(-1)))
            a = F.when(size == 0, F.col("a")).otherwise(at + size if _left(i, edits) else F.col("a"))
            b = F.when(size == 0, F.col("b")).otherwise(F.col("b") if _left(i, edits) else at)
            few = F.when(size == 0, edits).otherwise(_beside(i, edits))
            found.append(F.struct(key.alias("key"), F.col("mask").bitwiseOR(moved).alias("mask"), a.cast("int").alias("a"), b.cast("int").alias("b"), few.alias("edits")))
    return F.array(*found)


def _paired(rows: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """(x, y), x < y: ids of one key of which one is in place at every level and whose lines are `edits` apart at most.

    What near lines cannot differ in (length, characters) is asked first, then Spark's compiled and
    banded levenshtein, all within the join: only near pairs leave it.
    """
    held = rows.select("key", "id", "mask", *CARRIED).join(texts.select("id", "line"), "id")
    l, r = (lambda c: F.col(f"l.{c}")), (lambda c: F.col(f"r.{c}"))
    apart = sum((F.bit_count(l(c).bitwiseXOR(r(c))) for c in CARRIED[1:]), F.lit(0)) <= 2 * edits
    near = (l("id") < r("id")) & (l("mask").bitwiseAND(r("mask")) == 0) & (F.abs(l("n") - r("n")) <= edits) & apart & (F.levenshtein(l("line"), r("line"), edits) >= 0)
    return held.alias("l").join(held.alias("r"), (l("key") == r("key")) & near).select(l("id").alias("x"), r("id").alias("y"))


def candidates(live: DataFrame, texts: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(x, y): pairs of ids that may be near. Every pair within the threshold is among them.

    Lines that share a key are paired if they are HOT or fewer. Of a key with more, the rest of each
    line (what is left or right of the shared segment, in which all edits but those on the other side
    lie) is cut into segments in turn, and only lines that share one of those too go on.
    """
    rows, out = _rest(live, texts, edits, min_chars), None
    for level in range(1, LEVELS + 1):
        rows = written(rows, "keys")
        many = rows.groupBy("key").agg(F.count(F.lit(1)).alias("many")).where(F.col("many") > HOT)
        last = level == LEVELS or not many.limit(1).count()
        found = _paired(rows if last else rows.join(many, "key", "left_anti"), texts, edits)
        out = found if out is None else out.union(found)
        if last:
            return out.distinct()
        rows = _again(rows.join(many, "key", "left_semi"), texts, edits, level)


# --- verification --------------------------------------------------------------------------------


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once, however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def distance(a: Column, b: Column, edits: int) -> Column:
    """The edit distance of two lines if it is `edits` or less, else something above.

    Banded bit-parallel: of every column only the 2 * edits + 1 rows around the diagonal are kept, as
    bits of two numbers (where the distance grows and where it falls from one row to the next).
    Lengths may differ by `edits` at most.
    """
    # What both begin and end with does not count: cut off, turned, cut off again.
    begin = _let(F.struct(a.alias("a"), b.alias("b")), lambda s: _without_common_prefix(s["a"], s["b"]))
    turned = _let(begin, lambda s: F.struct(F.reverse(s["a"]).alias("a"), F.reverse(s["b"]).alias("b")))
    middle = _let(turned, lambda s: _without_common_prefix(s["a"], s["b"]))
    chars = lambda s: F.struct(*[F.filter(F.split(s[c], ""), lambda x: x != "").alias(c) for c in "ab"])
    return _let(_let(middle, chars), lambda s: _distance(s["a"], s["b"], edits))


def _without_common_prefix(a: Column, b: Column) -> Column:
    """Struct (a, b) without what both begin with (131,071 characters of it at most), found by halving."""
    at = F.lit(0)
    for step in range(16, -1, -1):
        at = _let(at, lambda p, w=1 << step: F.when((p + w <= F.least(F.char_length(a), F.char_length(b))) & (F.substring(a, p + 1, F.lit(w)) == F.substring(b, p + 1, F.lit(w))), p + w).otherwise(p))
    rest = lambda x, p: F.substring(x, p + 1, F.char_length(x))
    return _let(at, lambda p: F.struct(rest(a, p).alias("a"), rest(b, p).alias("b")))


def _distance(a: Column, b: Column, edits: int) -> Column:
    width = 2 * edits + 1
    full = (1 << width) - 1
    num = lambda x: F.lit(x).cast("long")
    inv = lambda x: x.bitwiseXOR(num(full))  # noqa: E731  of numbers within the band

    def match(c: Column, j: Column) -> Column:
        out = num(0)
        for k in range(width):
            out = out.bitwiseOR(F.when(F.get(a, j + F.lit(k - edits)) == c, num(1 << k)).otherwise(num(0)))
        return out

    def step(s: Column, c: Column) -> Column:
        # The diagonal never falls, and the last row is `edits` off it at most: beyond 2 * edits all is told.
        return F.when(s["d"] > 2 * edits, s).otherwise(_let(match(c, s["j"]), lambda eq: _let(same(eq, s["vp"], s["vn"]), lambda d0: below(d0, s["vp"], s["vn"], s["d"], s["j"]))))

    def same(eq: Column, vp: Column, vn: Column) -> Column:
        return ((eq.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(eq).bitwiseOR(vn).bitwiseAND(num(full))

    def below(d0: Column, vp: Column, vn: Column, d: Column, j: Column) -> Column:
        hp, hn = vn.bitwiseOR(inv(d0.bitwiseOR(vp))), d0.bitwiseAND(vp)
        down = F.shiftright(d0, 1)
        grown = d + F.when(d0.bitwiseAND(num(1 << edits)) == 0, 1).otherwise(0)
        return F.struct(hn.bitwiseOR(inv(down.bitwiseOR(hp))).alias("vp"), down.bitwiseAND(hp).alias("vn"), grown.alias("d"), (j + 1).alias("j"))

    start = F.struct(num(full ^ ((1 << edits) - 1)).alias("vp"), num(0).alias("vn"), F.lit(0).alias("d"), F.lit(0).alias("j"))
    off = F.size(a) - F.size(b)
    return _let(F.aggregate(b, start, step), lambda end: _to_last_row(end, off, edits))


def _to_last_row(end: Column, off: Column, edits: int) -> Column:
    """The distance on the diagonal moved by `off` rows to the last one, by what grows and falls in the last column."""
    num = lambda x: F.lit(x).cast("long")
    total, width = end["d"], 2 * edits + 1
    for k in range(width):
        delta = F.when(end["vp"].bitwiseAND(num(1 << k)) != 0, 1).otherwise(0) - F.when(end["vn"].bitwiseAND(num(1 << k)) != 0, 1).otherwise(0)
        total = total + (F.when(off > k - edits, delta).otherwise(0) if k >= edits else F.when(off <= k - edits, -delta).otherwise(0))
    return total


def near_pairs(docs: DataFrame, unique: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """Pairs of different lines at most `edits` apart (one below LONG_CHARS): a1, a2, b1, b2 (hashes), first_a, first_b."""
    live = written(live_rows(unique, edits), "live")
    ids = live.select("id").distinct()
    wanted = passing(unique.select(F.col("h1").alias("id"), "h2", "first"), F.col("id"), ids, F.col("id")).join(ids, "id", "left_semi")
    texts = written(texts_of(docs, written(wanted, "wanted"), min_chars), "texts")
    side = lambda df, x: df.select(*[F.col(c).alias(f"{c}_{x}") for c in df.columns])
    found = written(candidates(live, texts, edits, min_chars), "pairs")
    held = texts.select("id", "h2", "first", "n", "line")
    found = found.join(side(held, "a"), F.col("x") == F.col("id_a")).join(side(held, "b"), F.col("y") == F.col("id_b"))
    least = allowed(F.least("n_a", "n_b"), edits)
    # Bit vectors decide.
    found = found.where(F.abs(F.col("n_a") - F.col("n_b")) <= least)
    found = found.where(distance(F.col("line_a"), F.col("line_b"), edits) <= least)
    return found.select(F.col("id_a").alias("a1"), F.col("h2_a").alias("a2"), F.col("id_b").alias("b1"), F.col("h2_b").alias("b2"), "first_a", "first_b")


# --- cleaning ------------------------------------------------------------------------------------


def dropped(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """did, th, dropped (positions): lines of which an equal line, or a near one, comes earlier in the corpus.

    "Earlier" is by doc_id (null last, by text hash), text hash and position. No line goes unless a
    line within the threshold precedes it, and of equal lines the first decides for all.
    """
    unique = written(distinct_lines(docs, edits, min_chars), "lines")
    pairs = written(near_pairs(docs, unique, edits, min_chars), "near")
    later = F.col("first_a") > F.col("first_b")
    pick = lambda x, y: F.when(later, F.col(x)).otherwise(F.col(y))
    near = pairs.select(pick("a1", "b1").alias("h1"), pick("a2", "b2").alias("h2")).distinct().select("h1", "h2", F.lit(None).cast("decimal(38,0)").alias("first"))
    judged = unique.where("n > 1").select("h1", "h2", "first").union(near)
    judged = judged.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    light = occurrences(docs, min_chars).select("h1", "h2", "did", "th", "pos", F.pmod(F.col("did") + F.col("pos"), F.lit(SALTS)).cast("int").alias("salt"))
    gone = light.join(judged, ["h1", "h2", "salt"]).where(F.col("first").isNull() | (F.col("first") != place()))
    return gone.groupBy("did", "th").agg(F.collect_set("pos").alias("dropped"))


def cleaned(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, into: str | None = "dropped", sizes: str | None = None) -> DataFrame:
    """docs with the dropped lines taken out of text, and a column `into` (positions, null for none; none if into is None).

    Column `sizes`, if named, becomes the new text's number of characters where lines went.

    A column of docs that is named as `into` makes way for it. Null and empty texts, and texts of short lines
    only, come back unchanged; a document whose lines all go keeps an empty text. Repeated rows (equal
    doc_id and text) are judged as one and stay as many; rows of one doc_id with other texts are
    documents of their own.
    """
    gone = dropped(docs.select("doc_id", "text"), edits, min_chars).select(F.col("did").alias("_did"), F.col("th").alias("_th"), F.col("dropped").alias("_gone"))
    did, th = document_key()
    held = docs.select(did.alias("_d"), th.alias("_t"), *[F.col(c).alias(f"_z_{c}") for c in docs.columns])
    out = held.join(gone, (F.col("_d") == F.col("_did")) & (F.col("_t") == F.col("_th")), "left")
    left = lambda ls: F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("_gone")), lambda p: F.get(ls, p))
    text = F.when(F.col("_gone").isNull(), F.col("_z_text")).otherwise(F.array_join(_let(F.split(F.col("_z_text"), "\n"), left), "\n"))
    new = {"text": text}
    if sizes:
        new[sizes] = F.when(F.col("_gone").isNull(), F.col(f"_z_{sizes}")).otherwise(F.char_length(text).cast(docs.schema[sizes].dataType))
    more = [F.col("_gone").alias(into)] if into else []
    return out.select(*[new.get(c, F.col(f"_z_{c}")).alias(c) for c in docs.columns if c != into], *more)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = F.coalesce(F.size("dropped"), F.lit(0)).cast("long")
    return cleaned(docs, min_chars=ALL_LINES).select("doc_id", n.alias("dropped_lines"), F.char_length(text_or_empty()).cast("long").alias("kept_chars"), F.sha2(text_or_empty(), 256).alias("kept_sha256"))
