"""Benchmark decontamination with DataFrame and SQL functions only.

Texts become arrays of normalised words. The benchmark's windows are a hash set of whole
window strings, so a hit is verified by being found. While the counted set is small it
stands in the plan and each document is scanned where it lies, without a shuffle; a larger
set is joined.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import save

WINDOW = 10
#: Benchmark windows that stand in the plan as a hash set at most; more are joined.
MAX_SET_WINDOWS = 20_000
#: Joined windows that are broadcast at most.
MAX_BROADCAST_WINDOWS = 200_000

# The characters that separate words (ASCII only), and A-Z for lower-casing.
GAP = r"[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

HITS = "array<struct<at:int,n:int,win:string>>"
SPANS = "array<struct<a:int,b:int>>"


def words(col: str) -> str:
    """SQL for the words of a whole text, A-Z lower-cased: runs of digits, letters and
    non-ASCII characters. Null has none."""
    t = f"coalesce(`{col}`, '')"
    low = f"if(octet_length({t}) = length({t}), lower({t}), translate({t}, '{UPPER}', '{LOWER}'))"
    return f"filter(split({low}, '{GAP}'), x -> x <> '')"


def benchmark_windows(bench: DataFrame, id_col: str = "item_id", text_col: str = "text",
                      window: int = WINDOW) -> DataFrame:
    """(n, win, items): distinct windows as text, their length in words, the items (ids as
    strings) that hold them. An item of fewer words than a window is one window; an item
    without words has none. Items whose id is null match but are not listed."""
    w = bench.select(F.col(f"`{id_col}`").cast("string").alias("item"), F.expr(words(text_col)).alias("w"))
    w = w.filter(F.size("w") > 0).withColumn("n", F.least(F.size("w"), F.lit(window)))
    each = w.select("item", "n", F.explode(F.expr(
        "transform(sequence(1, size(w) - n + 1), i -> array_join(slice(w, i, n), ' '))")).alias("win"))
    return each.groupBy("n", "win").agg(F.collect_set("item").alias("items"))


@dataclass(frozen=True)
class WindowSet:
    table: DataFrame
    total: int
    #: SQL by window length for the test that a window begins at word i of w.
    tests: dict[int, str]

    def hits(self) -> str:
        """SQL for the window places in the words ``w``, with the windows' text."""
        each = [f"""transform(if(size(w) >= {n}, filter(sequence(1, greatest(1, size(w) - {n - 1})), i -> {test}), array()),
                    i -> struct(i as at, {n} as n, array_join(slice(w, i, {n}), ' ') as win))"""
                for n, test in sorted(self.tests.items())]
        return f"concat({', '.join(each)})" if each else f"cast(array() as {HITS})"

    def joined_table(self) -> DataFrame:
        return F.broadcast(self.table) if self.total <= MAX_BROADCAST_WINDOWS else self.table


def window_set(bench: DataFrame, item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> WindowSet:
    """The benchmark's windows, written once. A small set becomes SQL: hashes of word pairs at
    three places of a window are looked up first, as most places fail there, then the whole
    window. Words hold no quote or backslash, so they stand in SQL as they are."""
    table = save(benchmark_windows(bench, item_col, item_text, window), "benchmark-windows")
    total = table.count()
    if total > MAX_SET_WINDOWS:
        lengths = table.select("n").distinct().collect()  # at most ``window`` numbers
        return WindowSet(table, total, {r["n"]: "true" for r in lengths})
    pairs = lambda p: F.collect_set(F.expr(f"xxhash64(get(w, {p}), get(w, {p + 1}))"))
    tests = {}
    for r in table.groupBy("n").agg(F.collect_list("win").alias("wins")).collect():  # counted: at most MAX_SET_WINDOWS
        n, looks = r["n"], []
        places = sorted({0, max(0, n // 2 - 1), n - 2}) if n > 1 else []
        if places:
            got = table.filter(F.col("n") == n).select(F.split("win", " ").alias("w")).agg(
                *[pairs(p).alias(f"p{p}") for p in places]).first()
            looks = [f"xxhash64(get(w, i + {p - 1}), get(w, i + {p})) in ({','.join(f'{x}L' for x in sorted(got[f'p{p}']))})"
                     for p in places]
        some = ",".join(f"'{x}'" for x in sorted(r["wins"]))
        tests[n] = " and ".join([*looks, f"array_join(slice(w, i, {n}), ' ') in ({some})"])
    return WindowSet(table, total, tests)


def merged(hits: str) -> str:
    """SQL for the sorted disjoint [first word, last word + 1) that places cover."""
    return f"""aggregate(array_sort({hits}), cast(array() as {SPANS}), (s, x) ->
        if(size(s) > 0 and element_at(s, -1).b >= x.at - 1,
           concat(slice(s, 1, size(s) - 1), array(struct(element_at(s, -1).a as a,
                  greatest(element_at(s, -1).b, x.at - 1 + x.n) as b))),
           concat(s, array(struct(x.at - 1 as a, x.at - 1 + x.n as b)))))"""


def _in_words(col: str, body: str) -> Column:
    """``body`` over the words ``w`` of a text column, split once wherever the plan moves it."""
    return F.expr(f"transform(array({words(col)}), w -> {body})")[0]


def _found(docs: DataFrame, text_col: str, found: WindowSet) -> DataFrame:
    """``docs`` with a row number ``row`` and ``found``: number of words and verified hits."""
    if found.total <= MAX_SET_WINDOWS:
        return docs.select("*", F.monotonically_increasing_id().alias("row"),
                           _in_words(text_col, f"struct(size(w) as n, {found.hits()} as hits)").alias("found"))
    # a large benchmark: every window of a document is looked up by a join
    rows = save(docs.select("*", F.monotonically_increasing_id().alias("row")), "decontaminate")
    each = rows.select("row", F.explode(_in_words(text_col, found.hits())).alias("h")).select("row", "h.*")
    table = found.joined_table().select("n", "win")
    hit = each.join(table, ["n", "win"]).groupBy("row").agg(F.collect_list(F.struct("at", "n", "win")).alias("hits"))
    out = rows.join(hit, "row", "left")
    none = F.expr(f"cast(array() as {HITS})")
    return out.select(*rows.columns, F.struct(F.size(F.expr(words(text_col))).alias("n"),
                                              F.coalesce("hits", none).alias("hits")).alias("found"))


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: the id, ``n_words``, ``n_hit`` (words inside any occurrence
    of a benchmark window), ``items`` (ids, as strings in order, of items with occurring
    windows) and ``spans`` (merged [first word, last word + 1) of the hit words).

    A null or empty text has no words. Repeated rows are reported each and a null id stays.
    Texts of any length are scanned whole; other columns are not used. An empty table gives
    an empty result, an empty benchmark hits nothing.
    """
    found = window_set(bench, item_col, item_text, window)
    rows = _found(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), "text", found)
    listed = rows.select("row", "id", F.col("found.n").cast("long").alias("n_words"),
                         F.expr(merged("found.hits")).alias("spans"),
                         F.explode_outer(F.expr("array_distinct(transform(found.hits, x -> struct(x.n, x.win)))")).alias("h"))
    table = found.joined_table().select(F.col("n").alias("wn"), "win", "items")
    joined = listed.join(table, (F.col("h.n") == F.col("wn")) & (F.col("h.win") == F.col("win")), "left")
    out = joined.groupBy("row").agg(
        F.first("id").alias("id"), F.first("n_words").alias("n_words"), F.first("spans").alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    n_hit = F.expr("aggregate(spans, 0L, (s, x) -> s + x.b - x.a)")
    return out.select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), "items", "spans")


def drop_contaminated(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id",
                      item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` without the rows that hold a benchmark window. All columns stay; a row is judged
    by its text alone, so null or repeated ids do no harm. Null and empty texts stay."""
    found = window_set(bench, item_col, item_text, window)
    if found.total <= MAX_SET_WINDOWS:
        tests = [f"if(size(w) >= {n}, exists(sequence(1, greatest(1, size(w) - {n - 1})), i -> {test}), false)"
                 for n, test in sorted(found.tests.items())]
        return docs.filter(~_in_words(text_col, " or ".join(tests))) if tests else docs
    names, kept = docs.columns, docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("kept"),
                                            F.col(f"`{text_col}`").alias("text"))
    return _found(kept, "text", found).filter(F.size("found.hits") == 0).select(*[F.col(f"kept.`{c}`") for c in names])


def remove_spans(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id",
                 item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with the hit words cut out of contaminated texts, whose words are then
    lower-cased and joined by one space; clean texts stay as they are."""
    found = window_set(bench, item_col, item_text, window)
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("kept"), F.col(f"`{text_col}`").alias("text"))
    rows = _found(kept, "text", found).withColumn("spans", F.expr(merged("found.hits")))
    left = _in_words("text", "array_join(filter(w, (x, i) -> not exists(spans, s -> i >= s.a and i < s.b)), ' ')")
    cut = F.when(F.size("spans") > 0, left).otherwise(F.col("text"))
    return rows.select(*[cut.alias(c) if c == text_col else F.col(f"kept.`{c}`") for c in docs.columns])
