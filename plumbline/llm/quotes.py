"""Quotation linking: find what messages quote, link it to the original message, and order replies without the quotes."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

MARKS = re.compile(r"^((?:[ \t]*>)+)[ \t]?(.*)$", re.S)
WROTE = re.compile(r"^\s*(?:on\b.*\bwrote|le\b.*\ba écrit|am\b.*\bschrieb.*|el\b.*\bescribió)\s*:\s*$", re.I)
#: A sentence ends here.
END = re.compile(r"(?<=[.!?…])\s+")
#: Shorter passages are looked up in their own conversation only: elsewhere "yes, agreed" says nothing.
FAR_WORDS = 3


def parse(text: str | None) -> tuple[str, list[tuple[int, list[str]]]]:
    """(text without quotes and the lines that announce them, [(level, lines of the quoted passage)])."""
    body: list[str] = []
    quotes: list[tuple[int, list[str]]] = []
    before = 0
    for line in (text or "").split("\n"):
        found = MARKS.match(line)
        level = found[1].count(">") if found else 0
        if level:
            if not before and body and WROTE.match(body[-1]):
                body.pop()
            if level != before:
                quotes.append((level, []))
            quotes[-1][1].append(found[2])
        else:
            body.append(line)
        before = level
    return "\n".join(body).strip("\n"), [q for q in quotes if any(x.strip() for x in q[1])]


def passage_hash(text: str) -> tuple[str, int]:
    """(hash, words) of a passage, alike for case, white space and the marks around words."""
    words = re.findall(r"\w+", text.lower())
    return hashlib.blake2b(" ".join(words).encode(), digest_size=16).hexdigest(), len(words)


def passages(lines: list[str]) -> dict[str, int]:
    """Hash -> words of a passage as a whole, its paragraphs, its lines and its sentences."""
    whole = "\n".join(lines)
    paragraphs = re.split(r"\n\s*\n", whole)
    parts = [whole, *paragraphs, *lines, *(x for p in paragraphs for x in END.split(p))]
    return {h: n for h, n in map(passage_hash, parts) if n}


def _parsed(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row_id, text in zip(batch["row_id"], batch["text"], strict=True):
                body, quotes = parse(text if isinstance(text, str) else None)
                own = list(passages(body.split("\n"))) if body else []
                cited = [(level, h, n) for level, lines in quotes for h, n in passages(lines).items()]
                out.append((row_id, body, len(quotes), max((q[0] for q in quotes), default=0), own, [{"level": a, "hash": h, "words": n} for a, h, n in cited]))
            yield pd.DataFrame(out, columns=["row_id", "clean_text", "n_quotes", "max_level", "own", "cited"])

    return rows.mapInPandas(run, "row_id long, clean_text string, n_quotes long, max_level long, own array<string>, cited array<struct<level:int,hash:string,words:int>>")


def link_quotes(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, parent_conv, parent_turn, root_turn, depth, n_quotes, max_level, clean_text for each message.

    messages: conv_id, turn, role, text. The parent is the message that what is quoted was first written in: of the same
    conversation if one of its earlier turns has it, else of all conversations the first with it by (conv_id, turn),
    unless that is the message itself or a later one (passages of fewer than three words aren't looked up there). Of several, the shallowest quote level counts first, then the most
    quoted words, then the latest turn. In a conversation, root_turn and depth follow parents inside it; ordering by
    root_turn, turn puts every reply after its parent, thread by thread. A null or empty text has no quotes; repeated rows of a turn each give a row, linked alike; null conv_id or turn are
    never parents; other columns are ignored; an empty table gives no rows.
    """
    base = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    base = stored(base.withColumn("row_id", F.monotonically_increasing_id()), "messages")
    parsed = stored(base.select("row_id", "conv_id", "turn", "role").join(_parsed(base.select("row_id", "text")), "row_id"), "parsed")
    cited = parsed.filter(F.size("cited") > 0).select("row_id", "conv_id", "turn", F.explode("cited").alias("c")).select("row_id", "conv_id", "turn", "c.level", "c.hash", "c.words")
    cited = stored(cited, "cited")
    empty = parsed.select("row_id", F.lit(None).cast("long").alias("parent_conv"), F.lit(None).cast("long").alias("parent_turn")).limit(0)
    if not cited.limit(1).count():
        best = empty
    else:
        wanted = cited.select("hash").distinct()
        written = parsed.filter("conv_id is not null and turn is not null").select("conv_id", "turn", F.explode("own").alias("hash")).join(wanted, "hash", "left_semi")
        # one row for each passage of a conversation, and of all: a common passage meets each quote once
        inside = written.groupBy("conv_id", "hash").agg(F.min("turn").alias("own_turn"))
        anywhere = inside.groupBy("hash").agg(F.min(F.struct("conv_id", "own_turn")).alias("first"))
        found = cited.join(inside, ["conv_id", "hash"], "left").join(anywhere, "hash", "left")
        near = F.col("own_turn") < F.col("turn")
        far = (F.col("first.conv_id") < F.col("conv_id")) & (F.col("words") >= FAR_WORDS)
        found = found.select("row_id", "level", "words", F.when(near, F.col("conv_id")).when(far, F.col("first.conv_id")).alias("parent_conv"), F.when(near, F.col("own_turn")).when(far, F.col("first.own_turn")).alias("parent_turn"), F.coalesce(near, F.lit(False)).alias("near"))
        found = found.filter("parent_turn is not null").groupBy("row_id", "near", "parent_conv", "parent_turn").agg(F.min("level").alias("level"), F.sum("words").alias("words"))
        best = found.groupBy("row_id").agg(F.max(F.struct("near", (-F.col("level")).alias("l"), "words", "parent_turn", "parent_conv")).alias("b")).select("row_id", "b.parent_conv", "b.parent_turn")
    linked = stored(parsed.join(best, "row_id", "left"), "linked")

    # roots by doubling: each round follows twice as many links as the one before
    up = linked.filter("parent_conv = conv_id").groupBy("conv_id", "turn").agg(F.min("parent_turn").alias("up"), F.lit(1).cast("long").alias("steps"))
    up = stored(up, "up")
    while True:
        above = up.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("up2"), F.col("steps").alias("steps2"))
        more = stored(up.join(above, ["conv_id", "up"], "left").select("conv_id", "turn", F.coalesce("up2", "up").alias("up"), (F.col("steps") + F.coalesce("steps2", F.lit(0))).alias("steps"), F.col("up2").isNotNull().alias("moved")), "up")
        up = more.drop("moved")
        if not more.filter("moved").limit(1).count():
            break
    out = linked.join(up.select("conv_id", "turn", F.col("up").alias("root"), "steps"), ["conv_id", "turn"], "left")
    return out.select("conv_id", "turn", "role", "parent_conv", "parent_turn", F.coalesce("root", "turn").alias("root_turn"), F.coalesce("steps", F.lit(0)).alias("depth"), "n_quotes", "max_level", "clean_text")


def reply_ordered(linked: DataFrame) -> DataFrame:
    """link_quotes' result with place: the message's number, from 0, in its conversation's reply order (root_turn, turn).

    Equal turns stand in the order of their roles and texts; a null conv_id has no conversation and a null place. No
    conversation is gathered in one task: rows are sorted over all tasks, and what stands before a task's share of a
    conversation is summed up from one row for each task and conversation.
    """
    keys = ["conv_id", "root_turn", "turn", "role", "clean_text"]
    ordered = stored(linked.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("number", F.monotonically_increasing_id()), "ordered")
    ordered = ordered.withColumn("share", F.shiftright("number", 33))
    shares = ordered.filter("conv_id is not null").groupBy("conv_id", "share").agg(F.min("number").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    shares = shares.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    out = ordered.join(shares, ["conv_id", "share"], "left")
    return out.select(*linked.columns, (F.col("number") - F.col("first") + F.col("before")).alias("place"))


def conversations(linked: DataFrame) -> DataFrame:
    """One list of messages for each conversation of link_quotes' result, in reply order; use it where conversations are of bounded size."""
    place = F.struct("root_turn", "turn", "role", "clean_text")
    return linked.groupBy("conv_id").agg(F.sort_array(F.collect_list(place)).alias("messages"))
