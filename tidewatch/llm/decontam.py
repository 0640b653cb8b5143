"""Benchmark decontamination by template windows and slot consistency."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import cut

#: Typed placeholders: private-use characters that survive the removal of punctuation.
NUMBER, UNIT, NAME = "\ue000", "\ue001", "\ue002"
#: Stands before a capitalised word at the start of a text or sentence, which may be a name.
INITIAL = "\ue003"
WINDOW, LITERALS, RUN, COVER, AGREE = 8, 5, 6, 0.5, 0.8
#: With sentence-initial words as placeholders, a window needs so many literal words besides.
PLAIN = 3
#: Units of measure and money that may follow a number.
UNITS = (
    "mm cm km kg mg lb lbs oz ft mph kmh ml litres liters metres meters miles feet inches yards grams kilograms pounds tons "
    "seconds minutes hours days weeks months years dollars euros cents percent degrees"
).split()

_SPACE = r"[ \t\n\r]"
_NUMBERS = r"[0-9]+(?:[.,:/][0-9]+)*"
_UNITS = f"({NUMBER}{_SPACE}?)(?:{'|'.join(sorted(UNITS, key=len, reverse=True))})([^\\p{{L}}]|$)"
_NAMES = rf"\p{{Lu}}(?<=[\p{{Ll}}\p{{N}},;:)]{_SPACE}\p{{Lu}})[\p{{L}}'-]*"
_INITIALS = rf"(^|[.!?\n][\"')\]]*{_SPACE})({_SPACE}*[\"'(\[]*)(\p{{Lu}})"
_OTHER = rf"[^\p{{L}}\p{{N}} \t\n\r{NUMBER}{UNIT}{NAME}{INITIAL}]+"
_EDGES = r"^[^\p{L}\p{N}+-]+(?=.*[\p{L}\p{N}])|(?<=[\p{L}\p{N}])[^\p{L}\p{N}]+$"


def canonical(text: Column) -> Column:
    """The text as a template: names, numbers and units as placeholders, lower case, no punctuation. White space stays.

    A name is a capitalised word after a space that follows a lower-case letter, a digit or one of `,;:)`; a number is a
    run of digits with inner `.,:/`; a unit is one of UNITS right after a number. Capitalised words at the start of the
    text or of a sentence keep their letters after INITIAL; literal() and named() are the two readings of such a word.
    """
    s = F.regexp_replace(F.regexp_replace(text, _NAMES, NAME), _INITIALS, f"$1$2{INITIAL}$3")
    s = F.regexp_replace(s, _NUMBERS, NUMBER)
    s = F.regexp_replace(s, _UNITS, f"$1{UNIT}$2")
    return F.lower(F.regexp_replace(s, _OTHER, ""))


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(canonical(text), _SPACE), "")


def literal(of: Column) -> Column:
    return F.transform(of, lambda x: F.replace(x, F.lit(INITIAL), F.lit("")))


def named(of: Column) -> Column:
    return F.transform(of, lambda x: F.when(F.startswith(x, F.lit(INITIAL)), NAME).otherwise(x))


def exact_tokens(text: Column) -> Column:
    """Words with their values, lower-cased and without punctuation at their edges; signs and operators stay."""
    return F.array_remove(F.transform(F.split(F.lower(text), _SPACE), lambda x: F.regexp_replace(x, _EDGES, "")), "")


def raw_tokens(text: Column) -> Column:
    """Raw words in step with tokens(text)."""
    both = F.arrays_zip(F.split(canonical(text), _SPACE).alias("t"), F.split(text, _SPACE).alias("r"))
    return F.transform(F.filter(both, lambda x: x["t"] != ""), lambda x: x["r"])


def _word_hashes(of: Column) -> Column:
    return F.transform(of, lambda x: F.xxhash64(x))


def _with_windows(df: DataFrame, name: str, widths: list[int]) -> DataFrame:
    """df with `name{width}`: the hashes of all windows of each width over the word hashes in the array column `name`.

    Hashes of 1, 2, 4 ... words come from pairs of those of half the size, other widths from their binary parts, so a
    window costs a few hashes of two numbers whatever its width. Each level is a projection of its own, as Catalyst
    would otherwise compute it once for each use.
    """
    pair = lambda a, b, by: F.zip_with(a, F.slice(b, F.lit(1 + by), F.size(b)), lambda x, y: F.xxhash64(x, y))
    level = lambda k: F.col(f"_{name}{k}")
    kept = [F.col(c) for c in df.columns]
    made, size = df.withColumn(f"_{name}1", F.col(name)), 1
    while widths and 2 * size <= max(widths):
        made = made.withColumn(f"_{name}{2 * size}", pair(level(size), level(size), size))
        size *= 2
    out = []
    for w in widths:
        bits = [1 << k for k in range(w.bit_length()) if w >> k & 1][::-1]
        whole, done = level(bits[0]), bits[0]
        for k in bits[1:]:
            whole, done = pair(whole, level(k), done), done + k
        out.append(F.slice(whole, F.lit(1), F.greatest(F.size(name) - (w - 1), F.lit(0))).alias(f"{name}{w}"))
    return made.select(*kept, *out)


def _placeholder(token: Column) -> Column:
    return F.rlike(token, F.lit(f"[{NUMBER}{UNIT}{NAME}]"))


def _items(benchmark: DataFrame, window: int, literals: int) -> DataFrame:
    """(item_id, t, u, e, width, template) of the items: words in both readings, exact words, and the size of their windows.

    Windows have `window` words, or if no window of an item has enough literal words, twice as many and so on up to the
    whole item. Items that have too few literal words altogether are no templates and have windows of exact words.
    """
    t = F.col("t")
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    items = items.select("item_id", tokens(F.col("text")).alias("m"), exact_tokens(F.col("text")).alias("e")).where("size(m) > 0")
    items = items.select("item_id", literal(F.col("m")).alias("t"), named(F.col("m")).alias("u"), "e")
    doubled = F.transform(F.sequence(F.lit(0), F.lit(24)), lambda k: F.least(F.lit(window) * F.pow(F.lit(2), k).cast("int"), F.size(t)))
    enough = F.filter(F.array_distinct(doubled), lambda w: F.exists(_starts(t, w), lambda i: _literals(F.slice(t, i, w)) >= literals))
    items = items.withColumn("width", F.try_element_at(enough, F.lit(1))).withColumn("template", F.col("width").isNotNull())
    return items.withColumn("width", F.coalesce("width", F.least(F.lit(window), F.size("e"))))


def _literals(of: Column) -> Column:
    return F.aggregate(of, F.lit(0), lambda a, x: a + F.when(_placeholder(x), 0).otherwise(1))


def _starts(of: Column, width: Column) -> Column:
    return F.sequence(F.lit(1), F.size(of) - width + 1)


def _with_words(width: int) -> Callable[[Column], Column]:
    part = lambda name, at: F.slice(name, at + 1, F.lit(width))
    return lambda c: F.struct(c["at"].alias("at"), c["hash"].alias("hash"), c["other"].alias("other"), part("t", c["at"]).alias("wt"), part("u", c["at"]).alias("wu"))


def _item_windows(items: DataFrame, widths: list[int], template: bool, literals: int) -> DataFrame:
    """(item_id, width, total, at, hash, way) of the items' windows.

    way 0 are template windows with enough literal words, way 1 the same windows with sentence-initial words as names,
    way 2 windows of exact words.
    """
    cols, out = ["item_id", "width", "total", "at", "hash", "way"], None
    for w in widths:
        of = items.where((F.col("width") == w) & (F.col("template") == template)).select(
            "item_id", "t", "u", "e", F.lit(w).alias("width"), *[_word_hashes(F.col(c)).alias(f"h{c}") for c in "tue"]
        )
        for c in "tue":
            of = _with_windows(of, f"h{c}", [w])
        if template:
            cells = F.arrays_zip(F.sequence(F.lit(0), F.size("t") - w).alias("at"), F.col(f"ht{w}").alias("hash"), F.col(f"hu{w}").alias("other"))
            cells = F.transform(cells, _with_words(w))
            kept = of.withColumn("cells", F.filter(cells, lambda r: _literals(r.wt) >= literals))
            kept = kept.select("item_id", "width", F.size("cells").alias("total"), F.inline("cells"))
            plain = kept.withColumn("way", F.lit(0)).select(cols)
            changed = kept.where((F.col("hash") != F.col("other")) & (_literals(F.col("wu")) >= PLAIN))
            rows = plain.unionByName(changed.select("item_id", "width", "total", "at", F.col("other").alias("hash"), F.lit(1).alias("way")))
        else:
            rows = of.select("item_id", "width", F.size(f"he{w}").alias("total"), F.posexplode(f"he{w}").alias("at", "hash")).withColumn("way", F.lit(2)).select(cols)
        out = rows if out is None else out.unionByName(rows)
    return out


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    literals: int = LITERALS,
    run: int = RUN,
    cover: float = COVER,
    agree: float = AGREE,
) -> DataFrame:
    """(doc_id, item_id, n_windows, item_windows, coverage, n_slots, n_changed, kind) of every leak.

    docs (doc_id, text), benchmark (item_id, text). Both sides become templates; windows of `window` words with at least
    `literals` words that are no placeholder are hash-joined, once with sentence-initial words as they are and once with
    them as names. An item without such a window has longer ones, up to the whole item; one with fewer than `literals`
    literal words altogether is found by its exact words and values alone, by `run` windows or all of them (n_slots is 0, kind `exact`). A document leaks an item if it holds at least `run` of its windows, or the share
    `cover` of them, and the slots agree: along the steadiest alignment of the whole item, at least the share `agree` of
    the item's slot values each stand for one value of the document. kind is `exact` if no slot value changed, else
    `reparameterised`. n_windows counts the item's distinct matched windows, n_slots its distinct slot values that are
    aligned, n_changed those whose value differs. Null ids and texts take part in no leak; rows that repeat an id are judged together; other columns are
    ignored; empty tables give no rows.

    Texts are never shuffled for the windows: hashes join against the items' windows, read back from a written table, so that
    Catalyst broadcasts them only if their measured size is below its threshold and shuffles otherwise. Slot values are
    read in a second pass over matching documents alone.
    """
    prepared = cut(_items(benchmark, window, literals), "prepared")
    found = sorted((r[0], r[1]) for r in prepared.select("template", "width").distinct().collect())
    widths = {kind: [w for t, w in found if t == kind] for kind in (True, False)}
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    parts = [_item_windows(prepared, widths[kind], kind, literals) for kind in (True, False) if widths[kind]]
    hits = None
    if parts:
        items = cut(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]), "items")
        forms = [("t", 0), ("u", 1)] * bool(widths[True]) + [("e", 2)] * bool(widths[False])
        words = docs
        if widths[True]:
            words = words.withColumn("c", canonical(F.col("text")))
            split = lambda c: F.array_remove(F.split(c, _SPACE), "")
            initial = lambda x: F.when(F.startswith(x, F.lit(INITIAL)), F.xxhash64(F.lit(NAME))).otherwise(F.xxhash64(x))
            words = words.withColumn("t", _word_hashes(split(F.replace("c", F.lit(INITIAL), F.lit(""))))).withColumn("u", F.transform(split("c"), initial))
        if widths[False]:
            words = words.withColumn("e", _word_hashes(exact_tokens(F.col("text"))))
        words = words.select("doc_id", *[c for c, _ in forms])
        for c, way in forms:
            words = _with_windows(words, c, widths[way < 2])
        cells = [F.struct(F.lit(way).alias("form"), F.col(f"{c}{w}").alias("hashes")) for c, way in forms for w in widths[way < 2]]
        spread = words.select("doc_id", F.inline(F.array(*cells))).select("doc_id", "form", F.posexplode("hashes").alias("pos", "hash"))
        hits = spread.join(items, "hash").where("form = way").select("doc_id", "item_id", "pos", "at", "width", "total", "way")
    if hits is None:
        spark: SparkSession = docs.sparkSession
        ids = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {benchmark.schema['item_id'].dataType.simpleString()}"
        return spark.createDataFrame(
            [], ids + ", n_windows long, item_windows int, coverage double, n_slots long, n_changed long, kind string"
        )
    hits = cut(hits, "hits")
    seen = hits.groupBy("doc_id", "item_id", "at", "total").agg(F.min("way").alias("way"))
    counted = seen.groupBy("doc_id", "item_id", "total").agg(
        F.count(F.lit(1)).alias("n_windows"), F.sum(F.when(F.col("way") != 1, 1).otherwise(0)).alias("n_plain"), F.when(F.max("way") == 2, 1.0).otherwise(cover).alias("share")
    )
    enough = lambda n: (F.col(n) >= run) | (F.col(n) >= F.col("share") * F.col("total"))
    strong = cut(counted.where(enough("n_windows")).withColumn("named", ~enough("n_plain")).drop("n_plain", "share"), "strong")
    pairs = strong.select("doc_id", "item_id", "named")
    slots = _slots(docs, benchmark, hits.where("way < 2").join(pairs, ["doc_id", "item_id"]), strong)
    judged = strong.join(slots, ["doc_id", "item_id"], "left").na.fill(0, ["n_slots", "n_steady", "n_changed"])
    return judged.where(F.col("n_steady") >= agree * F.col("n_slots")).select(
        "doc_id",
        "item_id",
        "n_windows",
        F.col("total").alias("item_windows"),
        (F.col("n_windows") / F.col("total")).alias("coverage"),
        "n_slots",
        "n_changed",
        F.when(F.col("n_changed") == 0, "exact").otherwise("reparameterised").alias("kind"),
    )


def _slots(docs: DataFrame, benchmark: DataFrame, hits: DataFrame, strong: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_slots, n_steady, n_changed) of the steadiest alignment of items that have slots.

    An alignment is one shift between item and document that a matched window has; it compares the whole item.
    """

    def words(of: Column) -> Column:
        m = tokens(of)
        return F.arrays_zip(literal(m).alias("t"), named(m).alias("u"), raw_tokens(of).alias("r"))

    wanted_items = strong.select("item_id").distinct()
    item = benchmark.join(wanted_items, "item_id", "left_semi").select(
        "item_id", words(F.col("text").cast("string")).alias("iw")
    )
    slotted = cut(item.where(F.exists("iw", lambda x: _placeholder(x["u"]))), "slotted")
    lines = hits.groupBy("doc_id", "item_id", "named", (F.col("pos") - F.col("at")).alias("line")).agg(F.min(F.struct("at", "width")).alias("seen"))
    lines = lines.join(slotted.select("item_id", F.size("iw").alias("n")), "item_id")
    wanted = cut(lines.groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "line", "named", "seen", "n")).alias("lines")), "wanted")
    # a text is cut into words once, whatever the number of its lines, and only the words beside an item go on
    text = docs.join(wanted, "doc_id").select("doc_id", "lines", words(F.col("text")).alias("dw"))
    beside = lambda x: F.slice("dw", F.greatest(x["line"], F.lit(0)) + 1, F.greatest(x["n"] + F.least(x["line"], F.lit(0)), F.lit(0)))
    cells = F.transform("lines", lambda x: F.struct(*[x[k].alias(k) for k in ("item_id", "line", "named", "seen")], beside(x).alias("dw")))
    start = F.greatest(-F.col("line"), F.lit(0))

    def template(of: str, at: Column, form: str) -> Column:
        return F.transform(F.slice(of, at + 1, F.col("seen.width")), lambda x: x[form])

    same = F.lit(False)
    for form in ("t", "u"):
        same |= template("iw", F.col("seen.at"), form) == template("dw", F.col("seen.at") - start, form)
    pairs = F.arrays_zip(F.slice("iw", start + 1, F.size("dw")).alias("i"), F.col("dw").alias("d"))
    aligned = text.select("doc_id", F.inline(cells)).join(slotted, "item_id").where(same).select("doc_id", "item_id", "line", "named", F.explode(pairs).alias("p"))
    form = lambda side: F.when(F.col("named"), F.col(f"p.{side}.u")).otherwise(F.col(f"p.{side}.t"))
    aligned = aligned.withColumn("it", form("i")).withColumn("dt", form("d"))
    tidy = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")
    values = (
        aligned.where((F.col("it") == F.col("dt")) & _placeholder(F.col("it")))
        .groupBy("doc_id", "item_id", "line", tidy(F.col("p.i.r")).alias("was"), tidy(F.col("p.d.r")).alias("now"))
        .agg(F.max(_placeholder(F.col("p.i.t"))).alias("sure"))
    )
    per = values.groupBy("doc_id", "item_id", "line", "was").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("was") != F.col("now"), 1).otherwise(0)).alias("moved"), F.max("sure").alias("sure")
    )
    # a sentence-initial word that stays as it is counts as a slot only if it is a name elsewhere
    per = per.where("sure or moved = 1")
    per_line = per.groupBy("doc_id", "item_id", "line").agg(
        F.count(F.lit(1)).alias("n_slots"),
        F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).alias("n_steady"),
        F.sum("moved").alias("n_changed"),
    )
    best = F.max(F.struct((F.col("n_steady") / F.col("n_slots")).alias("share"), "n_slots", (-F.col("n_changed")).alias("kept"), "n_steady", "n_changed"))
    return per_line.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.n_slots", "b.n_steady", "b.n_changed")
