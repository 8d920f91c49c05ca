"""Conversations as token arrays: encoding with masks, placeholders, padding, positions and next-token pairs.

A conversation is an array of turns (input, output, output_with_loss, need_eos_token, sep), and everything on it is a column expression:
no Python, and no shuffle but the one that collects a conversation's turns. `ids` turns text into an array of int; any tokenizer
that is a column function will do, such as a lookup of what `tokens.ids_of` makes of `pieces`. Null text has no tokens, a null turn list gives null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labels that carry no loss, and the ids of image and query places (fixed values).
IGNORE, IMAGE_IN, IMAGE_OUT, QUERY = -100, -200, -300, -400
IMAGE_MARK, QUERY_MARK = "<image>", "<query>"
TURN = "struct<input:string,output:string,output_with_loss:boolean,need_eos_token:boolean,sep:string>"

Ids = Callable[[Column], Column]


def word_ids(text: Column) -> Column:
    """A toy tokenizer: one number for each word between blanks, from its first character and its length."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    return F.transform(words, lambda w: F.ascii(w) * 100 + F.length(w) % 100)


def expanded(text: Column, mark: str, place: int, times: Column | int, ids: Ids) -> Column:
    """Ids of a text in which one `mark` stands for `times` places; two marks are an error, none leaves the text as it is."""
    pieces = F.split(text, rf"\Q{mark}\E", -1)
    run = F.array_repeat(F.lit(place), times if isinstance(times, Column) else F.lit(times))
    two = F.concat(ids(F.get(pieces, F.lit(0))), run, ids(F.get(pieces, F.lit(1))))
    many = F.raise_error(F.lit(f"more than one {mark} in a turn")).cast("array<int>")
    return F.when(F.coalesce(F.size(pieces), F.lit(1)) < 2, ids(text)).when(F.size(pieces) == 2, two).otherwise(many)


def pieces(turns: Column) -> Column:
    """All texts that `encode` turns into ids: those of an array of turns, cut at the marks."""
    cut = lambda text, mark: F.split(F.coalesce(text, F.lit("")), rf"\Q{mark}\E", -1)
    whole = lambda text: F.array(F.coalesce(text, F.lit("")))
    of = lambda t: F.concat(*[whole(t[c]) for c in ("input", "output", "sep")], *[cut(t[c], m) for c, m in (("input", IMAGE_MARK), ("output", IMAGE_MARK), ("output", QUERY_MARK))])
    return F.array_distinct(F.flatten(F.transform(turns, of)))


def image_turn(prompt: Column, text: Column, with_image: bool = True) -> Column:
    """A conversation of one turn: an image and a prompt, answered by a text."""
    asked = F.concat(F.lit(f"{IMAGE_MARK}\n"), prompt) if with_image else prompt
    return F.array(F.struct(asked.alias("input"), text.alias("output"), F.lit(True).alias("output_with_loss"), F.lit(True).alias("need_eos_token"), F.lit("").alias("sep")))


def encode(turns: Column, ids: Ids, bos: int | None, eos: int, image_length: int = 1, query_length: int = 1, max_length: int | None = None, truncation: str | None = "right") -> Column:
    """struct(input_ids, labels) of an array of turns.

    Inputs carry no loss. An output carries it unless `output_with_loss` is false, and ends with `eos` unless `need_eos_token`
    is false; then the next turn has no `bos`. A separator follows without loss. Missing flags are true, a turn without output has none of its ending.
    """
    none = F.array().cast("array<int>")
    off = lambda a: F.array_repeat(F.lit(IGNORE), F.size(a))
    begin = F.array(F.lit(bos)) if bos is not None else none

    def step(acc: Column, t: Column) -> Column:
        lead = F.when(acc["bos"], begin).otherwise(none)
        asked = expanded(F.coalesce(t["input"], F.lit("")), IMAGE_MARK, IMAGE_IN, image_length, ids)
        has = t["output"].isNotNull()
        answer = F.when(F.contains(t["output"], F.lit(IMAGE_MARK)), expanded(t["output"], IMAGE_MARK, IMAGE_OUT, image_length, ids)).otherwise(expanded(t["output"], QUERY_MARK, QUERY, query_length, ids))
        ends = F.coalesce(t["need_eos_token"], F.lit(True))
        said = F.when(has, F.concat(answer, F.when(ends, F.array(F.lit(eos))).otherwise(none))).otherwise(none)
        sep = F.when(has & (F.coalesce(t["sep"], F.lit("")) != ""), ids(t["sep"])).otherwise(none)
        labels = F.when(F.coalesce(t["output_with_loss"], F.lit(True)), said).otherwise(off(said))
        return F.struct(
            F.concat(acc["ids"], lead, asked, said, sep).alias("ids"),
            F.concat(acc["labels"], off(lead), off(asked), labels, off(sep)).alias("labels"),
            F.when(has, ends).otherwise(acc["bos"]).alias("bos"),
        )

    start = F.struct(none.alias("ids"), none.alias("labels"), F.lit(True).alias("bos"))

    def finish(acc: Column) -> Column:
        cut = (lambda a: a) if max_length is None else (lambda a: truncated(a, max_length, truncation))
        return F.struct(cut(acc["ids"]).alias("input_ids"), cut(acc["labels"]).alias("labels"))

    return F.aggregate(turns, start, step, finish)


def truncated(a: Column, length: int, side: str | None) -> Column:
    """The first `length` items, or with `side` left the last; with no side, longer arrays are an error."""
    if side == "right":
        return F.slice(a, 1, length)
    if side == "left":
        return F.slice(a, F.greatest(F.size(a) - length + 1, F.lit(1)), F.lit(length))
    return F.when(F.size(a) <= length, a).otherwise(F.raise_error(F.lit(f"more than {length} tokens")).cast("array<int>"))


def collected(turns: DataFrame, key: str, order: str, turn: Column) -> DataFrame:
    """(key, turns): the turns of a conversation in order."""
    rows = turns.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), turn.cast(TURN).alias("t")))).alias("turns"))
    return rows.withColumn("turns", F.transform("turns", lambda x: x["t"]))


def padded(a: Column, length: Column | int, value: int) -> Column:
    """`value` before the items, up to `length`."""
    n = length if isinstance(length, Column) else F.lit(length)
    return F.concat(F.array_repeat(F.lit(value), F.greatest(n - F.size(a), F.lit(0))), a)


def mask(a: Column, length: Column | int) -> Column:
    """False for each place of padding, true for each item."""
    n = length if isinstance(length, Column) else F.lit(length)
    return F.concat(F.array_repeat(F.lit(False), F.greatest(n - F.size(a), F.lit(0))), F.array_repeat(F.lit(True), F.size(a)))


def positions(a: Column, length: Column | int) -> Column:
    """Position ids of a left-padded array: 0 over the padding, then 0, 1, 2 and so on."""
    n = F.greatest(length if isinstance(length, Column) else F.lit(length), F.size(a))
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.greatest(i - 1 - (n - F.size(a)), F.lit(0)))).otherwise(F.array().cast("array<int>"))


def next_tokens(labels: Column) -> Column:
    """(at, label): the places whose next label carries loss, and that label."""
    later = F.slice(labels, F.lit(2), F.greatest(F.size(labels) - 1, F.lit(0)))
    pairs = F.transform(later, lambda x, i: F.struct(i.alias("at"), x.alias("label")))
    return F.filter(pairs, lambda p: p["label"] >= 0)
