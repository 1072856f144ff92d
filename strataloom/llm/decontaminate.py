"""Benchmark decontamination by templates, in DataFrame functions only.

Texts are made templates: numbers, names and units become typed placeholders, letters lower case, punctuation goes. The
names are those of the benchmark: a capitalised word, or up to three in a row, marks a slot there, and in a document any
one to three words may stand in that slot, in any case and at a sentence's start. Windows of the benchmark's templates
are hash-joined with those of the documents'. Where a document agrees with an item along one alignment, the values in the
slots must fit: one value of the item stands for one value in the document throughout, and two names never for one.
So a question with other numbers or names in it is found like its literal copy.

Items of few tokens are one window, a template of the whole, and where numbers or names stand so close that few words are
between them, windows are wider or hold two names. Only what has no words of its own is looked for literally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.llm.common import row_key, written

WIDTH, PERCENT = 5, 80
#: Tokens that must not be numbers or units, for a window to count: of WIDTH in a row, of the four around a name.
LEAST_PLAIN, LEAST_AROUND = 3, 2
#: Words that may stand in the slot of a name.
NAME_WORDS = (1, 2, 3)
#: Per cent of an item's tokens that windows with slots for names must cover, for these windows to count alone.
LEAST_COVER = 60
#: Tokens by which neighbouring windows of one alignment may drift apart.
DRIFT = 4
#: Tokens of an item below which names near its ends are slots of the windows there.
SHORT = 10
#: Tokens of windows where WIDTH tokens hold too few words; shorter items are one window.
WIDE = 16
#: Bytes of the benchmark's windows, about, up to which they are broadcast. Beyond, a filter of 2 ** FILTER_BITS bits is, and
#: what it lets through is shuffled by the window's hash.
BROADCAST_BYTES, FILTER_BITS = 64 << 20, 26
# The units known after a number.
UNITS = [
    "km", "m", "cm", "mm", "mi", "mile", "miles", "ft", "feet", "inch", "inches", "yd", "yard", "yards",
    "kg", "g", "mg", "lb", "lbs", "pound", "pounds", "oz", "ounce", "ounces", "ton", "tons",
    "l", "ml", "litre", "litres", "liter", "liters", "gallon", "gallons",
    "sec", "secs", "second", "seconds", "min", "mins", "minute", "minutes", "h", "hr", "hrs", "hour", "hours",
    "day", "days", "week", "weeks", "month", "months", "year", "years",
    "hz", "khz", "mhz", "ghz", "kb", "mb", "gb", "tb", "w", "kw", "mw", "kv", "kj", "kcal", "cal", "pa", "kpa",
    "percent", "dollar", "dollars", "euro", "euros", "cent", "cents", "usd", "eur", "gbp",
]
PLAIN, NUMBER, UNIT, NAME = 0, 1, 2, 3
TOKEN = r"\p{Nd}+(?:[.,:/]\p{Nd}+)*|\p{L}[\p{L}\p{M}]*"
RK = ["_rk_id", "_rk_text"]


def fold(text: Column) -> Column:
    """Small letters that are the same for all cases of a text, sharp s and final sigma among them."""
    return F.replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def tokens(text: Column) -> Column:
    """Numbers, with the marks between their digits, and runs of letters, all letters small."""
    return F.regexp_extract_all(fold(text), F.lit(TOKEN), F.lit(0))


def _kind(token: Column, before: Column) -> Column:
    number = lambda x: x.between("0", ":")
    return F.when(number(token), NUMBER).when(F.coalesce(number(before), F.lit(False)) & token.isin(UNITS), UNIT).otherwise(PLAIN)


def kinds(of: str) -> Column:
    """NUMBER, UNIT or PLAIN for each token of the column."""
    return F.transform(of, lambda x, i: _kind(x, F.get(of, i - 1)))


def template(of: str) -> Column:
    """A hash for each token of the column, one and the same for all numbers and for all units."""

    def hashed(x: Column, i: Column) -> Column:
        kind = _kind(x, F.get(of, i - 1))
        return F.when(kind == PLAIN, F.xxhash64(x)).otherwise(kind.cast("long"))

    return F.transform(of, hashed)


def _row_hash(template: str, at: Column) -> Column:
    """WIDTH tokens of the template in a row."""
    return F.xxhash64(F.lit(1), *(F.get(template, at + k) for k in range(WIDTH)))


def _name_hash(template: str, at: Column, words: int, seed: int) -> Column:
    """Two tokens, a name of `words` words, two tokens; the name is left out."""
    return F.xxhash64(F.lit(10 + seed), *(F.get(template, at + k) for k in (0, 1, 2 + words, 3 + words)))


def _pair_hash(template: str, at: Column) -> Column:
    """A token, a name, a token, a name, a token."""
    return F.xxhash64(F.lit(60), *(F.get(template, at + k) for k in (0, 2, 4)))


def _whole_hash(template: str, at: Column, width: int, mask: int) -> Column:
    """`width` tokens in a row, names left out where the mask has a bit."""
    return F.xxhash64(F.lit(40 + width), F.lit(mask), *(F.get(template, at + k) for k in range(width) if not mask >> k & 1))


def _literal_hash(tokens: str, at: Column, width: int) -> Column:
    return F.xxhash64(F.lit(20 + width), *(F.get(tokens, at + k) for k in range(width)))


def _benchmark_tokens(bench: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item, copy, low, kind, template): each item's tokens; names have a kind of their own.

    A capitalised word is a name, but at a sentence's start only if the benchmark has it nowhere in small letters.
    """
    rows = bench.where(F.col(item_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).alias("text")).distinct()
    opened = F.lit(rf"(?:[.?!][^\p{{L}}\p{{Nd}}]*)?(?:{TOKEN})")
    each = rows.select("item", F.xxhash64("text").alias("copy"), F.posexplode(F.regexp_extract_all("text", opened, F.lit(0))).alias("i", "found"))
    each = each.select("item", "copy", "i", ((F.col("i") == 0) | F.col("found").rlike("^[.?!]")).alias("opens"), F.regexp_replace("found", r"^[^\p{L}\p{Nd}]+", "").alias("raw"))
    each = each.withColumn("low", fold(F.col("raw")))
    small = each.where((F.col("raw") == F.col("low"))).select("low", F.lit(True).alias("small")).distinct()
    name = F.col("raw").rlike(r"^\p{Lu}") & (~F.col("opens") | F.col("small").isNull())
    each = each.join(small, "low", "left").select("item", "copy", F.struct("i", "low", name.alias("name")).alias("t"))
    rows = each.groupBy("item", "copy").agg(F.sort_array(F.collect_list("t")).alias("t"))
    rows = rows.select("item", "copy", F.col("t.low").alias("low"), F.col("t.name").alias("name"))
    rows = rows.select("*", kinds("low").alias("own"), template("low").alias("template"))
    kind = F.zip_with("own", "name", lambda k, named: F.when((k == PLAIN) & named, NAME).otherwise(k))
    return rows.select("item", "copy", "low", kind.alias("kind"), "template")


def benchmark_windows(bench: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The windows of each item: (hash, item, copy, pos, place, as_is, slotted, slots, span, wide, whole, mask, n_as_is, n_slotted).

    as_is windows hold WIDTH tokens in a row, names as they are; with fewer than LEAST_PLAIN words they are literal,
    numbers included. slotted windows are those of them without names, those of two tokens, a name of up to three words
    and two tokens, and those of a token, a name, a token, a name and a token. place numbers the windows, n_as_is and
    n_slotted count them; n_slotted is 0 if they cover less than LEAST_COVER of the item.

    Items of up to WIDTH tokens are one window, as_is and slotted, with names as slots if three words are left, and
    literal without two words. Items of less than SHORT tokens have slotted windows of WIDTH tokens at both ends, with one or
    two names left out. Where WIDTH tokens hold too few words, items of less than WIDE tokens are one slotted
    window, and longer ones have slotted windows of WIDE tokens there, if these hold LEAST_PLAIN words.

    slots: type, place, words and value. span: tokens of the window. wide: the width of literal windows; whole, mask: the
    width of windows made by _whole_hash, and which of their tokens are left out.
    """
    rows = _benchmark_tokens(bench, item_col, text_col)
    n = F.size("low")
    n_words = F.size(F.filter("kind", lambda k: k == PLAIN))
    bits = F.aggregate(F.transform("kind", lambda k, i: F.when((k == NAME) & (i > 0), F.pow(F.lit(2), i).cast("long")).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a + x)
    # a word that opens a short item is none of its slots: too little would be left
    n_words = n_words + (F.get("kind", F.lit(0)) == NAME).cast("int")
    rows = rows.withColumn("mask", F.when((n <= WIDTH) & (n_words >= 3), bits).otherwise(0).cast("int"))
    words = F.when(F.col("mask") == 0, F.size(F.filter("kind", lambda k: k % NAME == PLAIN))).otherwise(n_words)
    rows = rows.withColumn("by_template", F.when(n <= WIDTH, (words >= 3) | ((words >= 2) & (n >= 4))).otherwise(words >= LEAST_PLAIN))
    of_words = lambda k: (F.get("kind", k) % NAME == PLAIN).cast("int")
    thin = lambda i: sum(of_words(i + k) for k in range(WIDTH)) < LEAST_PLAIN
    rows = rows.withColumn("thick", F.when(n > WIDTH, F.exists(F.sequence(F.lit(0), n - WIDTH), thin)).otherwise(False))
    rows = rows.withColumn("one", F.col("by_template") & ((n <= WIDTH) | (F.col("thick") & (n < WIDE))))
    # written, so that what tells an item's kind is not worked out again for each kind of window
    rows = written(rows.drop("own"), "benchmark-items")
    at = rows.select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("pos"))
    kind = lambda k: F.get("kind", F.col("pos") + k)
    plain = lambda places: sum((F.coalesce(kind(k) % NAME == PLAIN, F.lit(False))).cast("int") for k in places)
    # names count as words where they stand as they are

    def value(k: int, of: Column, kinds_: list[int], moved: int = 0) -> Column:
        one = F.struct(kind(k).alias("type"), F.lit(k + moved).alias("off"), F.lit(1).alias("words"), F.get("low", F.col("pos") + k).alias("value"))
        return F.when(kind(k).isin(kinds_) & of, one)

    yes, no, nothing = F.lit(True), F.lit(False), F.lit(None).cast("int")
    slot = lambda k, moved=0: value(k, yes, [NUMBER, UNIT], moved)
    none = F.expr("cast(array() as array<struct<type:int,off:int,words:int,value:string>>)")

    def window(
        where: Column, hashed: Column, place: int, as_is: Column, slotted: Column, slots: list[Column], width: Column | int, span: int | None = None,
        wide: Column = nothing, whole: Column = nothing, mask: Column = F.col("mask"),
    ) -> Column:
        width = F.lit(width) if isinstance(width, int) else width
        made = F.struct(
            hashed.alias("hash"), (F.col("pos") * 4 + place).alias("place"), as_is.alias("as_is"), slotted.alias("slotted"),
            (F.array_compact(F.array(*slots)) if slots else none).alias("slots"), F.sequence(F.col("pos"), F.col("pos") + width - 1).alias("cover"),
            (F.lit(span) if span else width).alias("span"), wide.cast("int").alias("wide"), whole.cast("int").alias("whole"), F.when(whole.isNotNull(), mask).alias("mask"),
        )
        return F.when(where, made)

    row, first, one = range(WIDTH), F.col("pos") == 0, F.col("one")
    fits = (n > WIDTH) & (F.col("pos") + WIDTH <= n)
    nameless = ~sum(F.coalesce(kind(k) == NAME, F.lit(False)).cast("int") for k in row).cast("boolean")
    # hashes leave nulls out, so these are those of _literal_hash and _whole_hash for a width that a column holds
    short_literal = F.xxhash64(20 + n, *(F.get("low", F.lit(k)) for k in range(WIDTH)))
    seen = [F.when((F.lit(k) < n) & (F.col("mask").bitwiseAND(1 << k) == 0), F.get("template", F.lit(k))) for k in range(WIDE)]
    whole_slots = [F.coalesce(slot(k), value(k, F.col("mask").bitwiseAND(1 << k) != 0, [NAME])) for k in range(WIDE)]
    thick_here = F.col("thick") & F.col("by_template") & (n >= WIDE) & (F.col("pos") + WIDE <= n) & (plain(row) < LEAST_PLAIN) & (plain(range(WIDE)) >= LEAST_PLAIN)
    two = sum(F.coalesce((kind(k) == NAME) == (k in (1, 3)), F.lit(False)).cast("int") for k in row) == WIDTH
    names_at = [slot(0), value(1, yes, [NAME]), slot(2), value(3, yes, [NAME]), slot(4)]
    own_mask = sum(F.when(F.coalesce(kind(k) == NAME, F.lit(False)) & (F.col("pos") + k > 0), 1 << k).otherwise(0) for k in row)
    around_names = sum(F.coalesce(kind(k) == PLAIN, F.lit(False)).cast("int") for k in row)
    at_edge = fits & (n < SHORT) & ~one & (first | (F.col("pos") + WIDTH == n)) & (own_mask > 0) & (F.bit_count(own_mask) <= 2) & (around_names >= LEAST_AROUND)
    unmasked = [F.when(own_mask.bitwiseAND(1 << k) == 0, F.get("template", F.col("pos") + k)) for k in row]
    edge_slots = [F.coalesce(slot(k), value(k, F.col("pos") + k > 0, [NAME])) for k in row]
    made = [
        window(at_edge, F.xxhash64(F.lit(40 + WIDTH), own_mask, *unmasked), 3, no, yes, edge_slots, WIDTH, whole=F.lit(WIDTH), mask=own_mask),
        window(fits & (plain(row) >= LEAST_PLAIN), _row_hash("template", F.col("pos")), 0, yes, nameless & ~one, [slot(k) for k in row], WIDTH),
        window(fits & (plain(row) < LEAST_PLAIN), _literal_hash("low", F.col("pos"), WIDTH), 0, yes, no, [], WIDTH, wide=F.lit(WIDTH)),
        window(first & (n <= WIDTH) & ~one, short_literal, 0, yes, no, [], n, wide=n),
        window(first & one, F.xxhash64(40 + n, F.col("mask"), *seen), 3, n <= WIDTH, yes, whole_slots, n, whole=n),
        window(thick_here, _whole_hash("template", F.col("pos"), WIDE, 0), 3, no, yes, [slot(k) for k in range(WIDE)], WIDE, whole=F.lit(WIDE)),
        window((n > WIDTH) & ~one & two & (plain((0, 2, 4)) >= LEAST_AROUND), _pair_hash("template", F.col("pos")), 2, no, yes, names_at, WIDTH),
    ]
    for words_ in NAME_WORDS:
        around = [0, 1, 2 + words_, 3 + words_]
        holds = sum(F.coalesce(kind(k) != NAME, F.lit(False)).cast("int") for k in around) + sum(F.coalesce(kind(2 + k) == NAME, F.lit(False)).cast("int") for k in range(words_))
        named = (n > WIDTH) & ~one & (holds == 4 + words_) & (plain(around) >= LEAST_AROUND)
        name = F.array_join(F.slice("low", F.col("pos") + 3, F.lit(words_)), " ")
        for other in NAME_WORDS:
            held = F.struct(F.lit(NAME).alias("type"), F.lit(2).alias("off"), F.lit(other).alias("words"), name.alias("value"))
            slots = [slot(0), slot(1), held, *(slot(k, other - words_) for k in around[2:])]
            made.append(window(named, _name_hash("template", F.col("pos"), words_, other), 1, no, yes, slots, 4 + words_, span=4 + other))
    each = at.select("item", "copy", "pos", n.alias("n_tokens"), F.explode(F.array_compact(F.array(*made))).alias("w")).select("item", "copy", "pos", "n_tokens", "w.*")
    each = written(each, "windows")
    count = lambda which: F.count_distinct(F.when(F.col(which), F.col("place")))
    covered = F.size(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("slotted"), F.col("cover"))))))
    sizes = each.groupBy("item", "copy").agg(
        count("as_is").alias("n_as_is"), F.when(100 * covered >= LEAST_COVER * F.first("n_tokens"), count("slotted")).otherwise(0).alias("n_slotted")
    )
    return each.drop("cover", "n_tokens").join(sizes, ["item", "copy"])


def _thinned(each: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of which the hash may be one of the items': a bit for each hash, 64 a row, 2 ** (FILTER_BITS - 6) rows at most."""
    word = F.expr(f"pmod(hash >> 6, {1 << FILTER_BITS - 6})").alias("_word")
    bit = F.expr("CAST(hash & 63 AS INT)")
    bits = items.select(word, F.expr("shiftleft(1L, CAST(hash & 63 AS INT))").alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    return each.select("*", word).join(F.broadcast(bits), "_word").where(F.getbit("_bits", bit) == 1).drop("_word", "_bits")


def leaks(
    docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", percent: int = PERCENT,
) -> DataFrame:
    """(_rk_id, _rk_text, id, item_id, n_windows, n_found, n_changed) of each document and item found in it.

    An item is found if at least `percent` per cent of its windows, names as they are or in slots, are in the document
    on alignments whose slots are consistent: a number, unit or name of the item stands for one value throughout, and
    two names for two. n_changed is the number of slot values that differ: 0 for literal copies. Items without words of
    their own, rows of numbers or of names, are found as literal copies, case and punctuation aside. Items with a null
    id or without tokens are never found. Null and empty documents hold nothing; very long ones are read whole. Rows of
    equal id and text count once. Empty tables give no rows. Columns with other names are not read.
    """
    items = written(benchmark_windows(bench, item_col, item_text_col), "benchmark-windows")
    shape = F.when(F.col("whole").isNotNull(), F.struct("whole", "mask"))
    size = items.agg(
        F.sum(150 + 80 * F.size("slots")).alias("bytes"), F.sort_array(F.collect_set("wide")).alias("widths"), F.sort_array(F.collect_set(shape)).alias("shapes"), F.max("span").alias("span"),
    ).first()  # widths are WIDTH at most; shapes are those of WIDTH tokens and one a width up to WIDE
    rows = docs.select(*row_key(id_col, text_col), F.col(id_col).alias("_id"), tokens(F.col(text_col)).alias("_tokens"))
    rows = rows.select("*", template("_tokens").alias("_template")).where(F.size("_tokens") > 0)
    at = F.col("at")
    each = rows.select("*", F.explode(F.sequence(F.lit(0), F.size("_tokens") - 1)).alias("at"))
    hashes = [
        _row_hash("_template", at), *(_name_hash("_template", at, w, w) for w in NAME_WORDS), _pair_hash("_template", at),
        *(_literal_hash("_tokens", at, w) for w in size.widths), *(_whole_hash("_template", at, w, m) for w, m in size.shapes),
    ]
    each = each.select("*", F.explode(F.array(*hashes)).alias("hash"))
    own = F.slice("_tokens", at + 1, F.lit(size.span or 1)).alias("_own")
    if (size.bytes or 0) <= BROADCAST_BYTES:
        met = each.join(F.broadcast(items), "hash").select(*RK, "_id", "at", own, *items.columns)  # in one pass: only matches keep tokens
    else:
        met = _thinned(each.select(*RK, "at", "hash"), items).join(items, "hash").join(rows.select(*RK, "_id", "_tokens"), RK).select(*RK, "_id", "at", own, *items.columns)
    met = written(met.where(F.size("_own") >= F.col("span")), "met")
    value = lambda s: F.array_join(F.slice("_own", s["off"] + 1, s["words"]), " ")
    values = F.transform("slots", lambda s: F.struct(s["type"].alias("type"), s["value"].alias("value"), value(s).alias("theirs")))
    pair = [*RK, "item", "copy"]
    met = met.select(*pair, "_id", "place", "as_is", "slotted", "n_as_is", "n_slotted", (at - F.col("pos")).alias("shift"), values.alias("values"))
    along = Window.partitionBy(*pair).orderBy("shift", "place")
    torn_off = F.when(F.col("shift") - F.lag("shift").over(along) > DRIFT, 1).otherwise(0)
    met = met.withColumn("_off", torn_off).withColumn("alignment", F.sum("_off").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    places = lambda which: F.collect_set(F.when(F.col(which), F.col("place"))).alias(which)
    aligned = met.groupBy(*pair, "alignment").agg(
        F.first("_id").alias("_id"), F.first("n_as_is").alias("n_as_is"), F.first("n_slotted").alias("n_slotted"), places("as_is"), places("slotted"),
        F.array_distinct(F.flatten(F.collect_set("values"))).alias("values"),
    )
    one_each = F.size(F.array_distinct(F.transform("values", lambda v: F.struct(v["type"], v["value"])))) == F.size("values")
    names = F.filter("values", lambda v: v["type"] == NAME)
    names_apart = F.size(F.array_distinct(F.transform(names, lambda v: v["theirs"]))) == F.size(names)
    changed = F.size(F.filter("values", lambda v: v["value"] != v["theirs"]))
    fit = aligned.where(one_each & names_apart).withColumn("n_changed", changed.cast("long"))
    union = lambda which: F.size(F.array_distinct(F.flatten(F.collect_list(which)))).cast("long").alias(f"met_{which}")
    found = fit.groupBy(*pair).agg(F.first("_id").alias("_id"), F.first("n_as_is").alias("n_as_is"), F.first("n_slotted").alias("n_slotted"), union("as_is"), union("slotted"), F.max("n_changed").alias("n_changed"))
    whole = 100 * F.col("met_as_is") >= percent * F.col("n_as_is")
    found = found.where(whole | ((F.col("n_slotted") > 0) & (100 * F.col("met_slotted") >= percent * F.col("n_slotted"))))
    count = lambda name, kind: F.when(whole, F.col(f"{kind}_as_is")).otherwise(F.col(f"{kind}_slotted")).cast("long").alias(name)
    found = found.select(*RK, F.col("_id").alias(id_col), F.col("item").alias("item_id"), count("n_windows", "n"), count("n_found", "met"), "n_changed")
    return found.dropDuplicates([*RK, "item_id"])


def clean(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs, with all their columns, in which no item is found; takes the arguments of leaks()."""
    keys = leaks(docs, bench, id_col, text_col, **how).select(*RK).distinct()
    rows = docs.select(*row_key(id_col, text_col), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    return rows.join(keys, RK, "left_anti").select("_row.*")
