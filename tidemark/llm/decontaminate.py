"""Benchmark decontamination by template windows, in DataFrame functions alone.

A text becomes a template: numbers, names and units turn into typed placeholders, the other words lose case and
punctuation. Windows of template words are hashed and joined; a pair of text and item that shares one is then
aligned word by word, and its slots must be filled consistently (one value of the item always stands for one value of
the text). So an item is found again when it is copied and when its numbers or names are exchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import col, record, unpack
from tidemark.session import cut_lineage

# Placeholders are private-use characters, which no word of a template can hold otherwise.
NAME, NUMBER, UNIT = "\ue000", "\ue001", "\ue002"
SLOTS = f"[{NAME}{NUMBER}{UNIT}]"
#: Units that count as such after a number.
UNITS = (
    "mm cm m km in ft yd mi mg g kg t lb lbs oz ml l s sec secs second seconds min mins minute minutes h hr hrs hour hours "
    "day days week weeks month months year years km2 m2 m3 mph kmh hz khz mhz ghz w kw mw v kv a j kj cal kcal pa kpa bar "
    "c f k percent pct usd eur gbp dollars dollar euros euro cents cent pounds pound metres meters metre meter kilometres "
    "kilometers miles mile feet foot inches inch litres liters litre liter grams gram kilograms kilogram degrees degree"
).split()
UNIT_PATTERN = "|".join(UNITS)


def _words(text: Column) -> Column:
    """Words between single blanks; none for blank text."""
    trimmed = F.trim(text)
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, " "))


def _plain(text: Column) -> Column:
    """Lower case, one blank for every run of blanks and punctuation. Numbers lose their separators and attached units stand
    apart. Texts without digits, most of them, skip the passes for numbers."""
    has_digits = text.rlike(r"[0-9]")
    joined = F.when(has_digits, F.regexp_replace(text, r"(?<=[0-9])[.,:/](?=[0-9])", "")).otherwise(text)
    bare = F.regexp_replace(F.lower(joined), r"[^\p{L}\p{N}\p{Co}]+", " ")
    apart = F.regexp_replace(bare, rf"\b([0-9]+)({UNIT_PATTERN})\b", "$1 $2")
    return F.when(has_digits, apart).otherwise(bare)


def plain_words(text: Column) -> Column:
    """The words of a text in lower case without punctuation, one for each word of :func:`template_words`."""
    return _words(_plain(F.coalesce(text, F.lit(""))))


def template_words(text: Column) -> Column:
    """The words of the template. A capitalised word inside a sentence is a name, digits are a number, and a unit is one
    of UNITS after a number."""
    filled = F.coalesce(text, F.lit(""))
    plain = _plain(F.regexp_replace(filled, r"\p{Lu}(?<=[^\s.!?:]\s\p{Lu})\p{L}*+(?!\p{N})", NAME))
    numbered = F.regexp_replace(plain, r"(?<![^ ])[0-9]+(?![^ ])", NUMBER)
    typed = F.regexp_replace(numbered, rf"(?<={NUMBER} )(?:{UNIT_PATTERN})(?![^ ])", UNIT)
    return _words(F.when(filled.rlike(r"[0-9]"), typed).otherwise(plain))


def _window(words: Column, start: Column, width: Column) -> Column:
    return F.xxhash64(F.slice(words, start + 1, width))


def _windows(words: Column, width: Column, stride: int = 1) -> Column:
    """Hashes of the windows that start at 0, stride, 2*stride, ...; none for fewer words than ``width``."""
    last = F.floor((F.size(words) - width) / stride).cast("int")
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: _window(words, i * stride, width))


def item_windows(items: DataFrame, text: str, id_col: str, width: int, stride: int, min_literals: int) -> DataFrame:
    """One row per item: id, words ``t``, plain words ``r``, window width ``w`` and its windows (p, h) that hold enough literal
    words. An item of fewer than width + stride - 1 words is one window of all its words. An item without such a window is
    ``plain``: its words are its plain words, slots and all, and it keeps every window. ``gaps`` says that windows are left out.

    The first word of an item is literal, but in a text it is a name inside a sentence, or a unit after a number. The first
    window therefore comes in these forms too (``first``); they match only where the text has the same plain word there."""
    rows = items.select(
        col(id_col).alias("item"), template_words(col(text)).alias("t"), plain_words(col(text)).alias("r"),
        F.coalesce(col(text), F.lit("")).rlike(r"^[^\p{L}\p{N}\p{Co}]*\p{Lu}").alias("capital"),
    )
    n = F.size("t")
    rows = rows.filter(n > 0).withColumn("w", F.when(n < width + stride - 1, n).otherwise(F.lit(width)))
    every = F.sequence(F.lit(0), n - col("w"))
    literal = lambda p: F.size(F.filter(F.slice(col("t"), p + 1, col("w")), lambda x: ~x.rlike(SLOTS)))
    rows = rows.withColumn("starts", F.filter(every, lambda p: literal(p) >= F.least(F.lit(min_literals), col("w"))))
    rows = rows.withColumn("plain", F.size("starts") == 0)
    rows = rows.withColumns({"t": F.when(col("plain"), col("r")).otherwise(col("t")), "starts": F.when(col("plain"), every).otherwise(col("starts"))})
    windows = F.transform("starts", lambda p: F.struct(p.alias("p"), _window(col("t"), p, col("w")).alias("h"), F.lit(False).alias("first")))
    literal_first = ~col("plain") & F.array_contains("starts", 0) & ~F.get("t", F.lit(0)).rlike(SLOTS)
    forms = F.concat(
        F.when(literal_first & col("capital"), F.array(F.lit(NAME))).otherwise(F.array().cast("array<string>")),
        F.when(literal_first & F.get("t", F.lit(0)).isin(UNITS), F.array(F.lit(UNIT))).otherwise(F.array().cast("array<string>")),
    )
    behind = F.slice(col("t"), F.lit(2), col("w") - 1)
    others = F.transform(
        forms, lambda x: F.struct(F.lit(0).alias("p"), F.xxhash64(F.concat(F.array(x), behind)).alias("h"), F.lit(True).alias("first"))
    )
    rows = rows.withColumn("wins", F.concat(windows, others)).withColumn("kept", F.size("starts"))
    return rows.withColumn("gaps", col("kept") < n - col("w") + 1).drop("starts", "capital")


def _matches() -> Column:
    """Pairs of equal windows of text and item as struct(shift, p), from columns td, rd, r, w, wins."""
    starts = F.when(F.size("td") >= col("w"), F.sequence(F.lit(0), F.size("td") - col("w"))).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(col("wins"), lambda x: x["h"])
    places = F.filter(
        F.transform(starts, lambda i: F.struct(i.alias("i"), _window(col("td"), i, col("w")).alias("h"))),
        lambda x: F.array_contains(hashes, x["h"]),
    )
    return F.flatten(
        F.transform(
            places,
            lambda x: F.transform(
                F.filter(
                    col("wins"), lambda y: (y["h"] == x["h"]) & (~y["first"] | (F.get(col("rd"), x["i"]) == F.get(col("r"), F.lit(0))))
                ),
                lambda y: F.struct((x["i"] - y["p"]).alias("shift"), y["p"].alias("p")),
            ),
        )
    )


def leaks(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_text: str = "text",
    item_id: str = "item_id",
    width: int = 5,
    stride: int = 4,
    coverage: float = 0.8,
    min_literals: int = 3,
    broadcast_windows: int = 2_000_000,
    broadcast_keys: int = 500_000,
) -> DataFrame:
    """(key, item, coverage, shift, slots): the items that a text holds; ``key`` is the MD5 of the text (null is empty).

    An item counts as held when consistent alignments cover at least ``coverage`` of its windows. Every window of an item
    meets every ``stride``-th window of a text: if four fifths of the windows are covered, four of them follow each other
    somewhere (an edit inside costs four windows at least), and one of four starts on the stride. That needs all windows of
    the item, so once any item leaves out windows that hold too few literal words, all windows of the texts are met. Shorter
    items meet all windows of their length. An item without a window of ``min_literals`` literal words (all words, if
    the item has fewer) is compared by its plain words, numbers and names as they stand: it is found where it is copied, not
    where its slots are exchanged. Items without words are not searched. Equal texts are examined once.
    Windows of items are broadcast up to ``broadcast_windows`` rows of 16 bytes, and the keys of texts that share one up to
    ``broadcast_keys`` rows of 32 bytes; above these bounds the joins shuffle, with the same result.
    """
    wanted = cut_lineage(item_windows(items, item_text, item_id, width, stride, min_literals))
    flat = cut_lineage(wanted.select("item", "plain", "w", "gaps", F.explode("wins.h").alias("h")).distinct())
    kinds = flat.groupBy("plain", "w").agg(F.max("gaps").alias("gaps")).orderBy("plain", "w").collect()
    small = flat.count() <= broadcast_windows
    probe = F.broadcast(flat.drop("gaps")) if small else flat.drop("gaps")

    base = docs.select(F.coalesce(col(text), F.lit("")).alias("text"))
    words = {False: template_words(col("text")).alias("td"), True: plain_words(col("text")).alias("rd")}
    keyed = base.select(F.md5(col("text").cast("binary")).alias("key"), *[words[p] for p in sorted({k["plain"] for k in kinds})])

    def sized(plain: bool, w: int, gaps: bool) -> Column:
        hashes = _windows(col("rd" if plain else "td"), F.lit(w), stride if w == width and not gaps else 1)
        return F.transform(hashes, lambda h: F.struct(F.lit(plain).alias("plain"), F.lit(w).alias("w"), h.alias("h")))

    arrays = [sized(*k) for k in kinds] or [F.array().cast("array<struct<plain:boolean,w:int,h:bigint>>")]
    seen = keyed.select("key", F.inline(F.concat(*arrays) if len(arrays) > 1 else arrays[0]))
    pairs = cut_lineage(seen.join(probe, ["plain", "w", "h"]).select("key", "item").distinct())

    keys = cut_lineage(pairs.select("key").distinct())
    keys = F.broadcast(keys) if keys.count() <= broadcast_keys else keys
    texts = base.withColumn("key", F.md5(col("text").cast("binary"))).join(keys, "key", "left_semi")
    texts = texts.dropDuplicates(["key"]).select("key", template_words(col("text")).alias("td"), plain_words(col("text")).alias("rd"))
    both = texts.join(pairs, "key").join(wanted, "item")
    both = both.withColumn("td", F.when(col("plain"), col("rd")).otherwise(col("td"))).withColumn("m", _matches())
    shifts = both.withColumn("s", F.array_distinct(F.transform("m", lambda x: x["shift"])))

    def at(shift: Column) -> Column:
        """One alignment: its item windows, and whether no slot value of the item stands for two values of the text."""
        own = F.transform(F.filter(col("m"), lambda x: x["shift"] == shift), lambda x: x["p"])
        spots = F.array_distinct(F.flatten(F.transform(own, lambda p: F.sequence(p, p + col("w") - 1))))
        slots = F.filter(spots, lambda q: F.get(col("t"), q).rlike(SLOTS))
        left = F.array_distinct(F.transform(slots, lambda q: F.get(col("r"), q)))
        together = F.array_distinct(F.transform(slots, lambda q: F.concat_ws(" ", F.get(col("r"), q), F.get(col("rd"), q + shift))))
        return F.struct(shift.alias("shift"), own.alias("own"), F.size(left).alias("slots"), (F.size(left) == F.size(together)).alias("agree"))

    good = shifts.withColumn("good", F.filter(F.transform("s", at), lambda a: a["agree"]))
    measured = good.select(
        "key",
        "item",
        (F.size(F.array_distinct(F.flatten(F.transform("good", lambda a: a["own"])))) / col("kept")).alias("coverage"),
        F.array_max(F.transform("good", lambda a: F.struct(F.size(a["own"]).alias("n"), (-a["shift"]).alias("back"), a["slots"].alias("slots")))).alias("best"),
    )
    return measured.filter(col("coverage") >= coverage).select(
        "key", "item", "coverage", (-F.col("best.back")).alias("shift"), F.col("best.slots").alias("slots")
    )


def mark_leaks(docs: DataFrame, items: DataFrame, text: str = "text", carry: list[str] | None = None, broadcast_found: int = 500_000, **options) -> DataFrame:
    """A row for each row of ``docs`` and item that it holds: its columns, ``item_id``, ``coverage`` (share of the item's windows),
    ``shift`` (word of the text at which the item would start) and ``slots`` (distinct slot values that were compared).

    Clean rows do not appear; nor do rows when either table is empty. Repeated rows appear as often as they do in
    ``docs``. Results replace columns of their names. Options as in :func:`leaks`.
    """
    columns = docs.columns if carry is None else carry
    found = cut_lineage(leaks(docs, items, text, **options))
    found = F.broadcast(found) if found.count() <= broadcast_found else found
    rows = docs.select(record(docs, columns), F.md5(F.coalesce(col(text), F.lit("")).cast("binary")).alias("key"))
    return unpack(
        rows.join(found, "key"), columns, item_id=col("item"), coverage=col("coverage"), shift=col("shift"), slots=col("slots")
    )


def drop_leaks(docs: DataFrame, items: DataFrame, text: str = "text", broadcast_found: int = 500_000, **options) -> DataFrame:
    """The rows of ``docs`` that hold no item, unchanged. All rows stay when there are no items."""
    found = cut_lineage(leaks(docs, items, text, **options).select("key").distinct())
    found = F.broadcast(found) if found.count() <= broadcast_found else found
    rows = docs.select(record(docs), F.md5(F.coalesce(col(text), F.lit("")).cast("binary")).alias("key"))
    return unpack(rows.join(found, "key", "left_anti"), docs.columns)
