"""Quotation linking: conversations in reply order, without the quotes."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, last_before

_QUOTE = re.compile(r"^((?:\s?>)+)\s?(.*)$", re.DOTALL)
_INTRODUCTION = re.compile(r"^\S.{0,200}\b(wrote|schrieb|a écrit|escribió)\s*:\s*$")


def parse(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """(own text, quoted passages): a passage is a run of lines of one quote level, as (level, text).

    A line that introduces a quote ("... wrote:") goes with it. Null counts as empty.
    """
    own, passages = [], []
    last = 0
    for line in (text or "").split("\n"):
        m = _QUOTE.match(line)
        level, line = (m[1].count(">"), m[2]) if m else (0, line)
        if level:
            if last == 0 and own and _INTRODUCTION.match(own[-1]):
                own.pop()
            if level == last:
                passages[-1][1].append(line)
            else:
                if passages and passages[-1][1] and level > last > 0 and _INTRODUCTION.match(passages[-1][1][-1]):
                    passages[-1][1].pop()
                passages.append((level, [line]))
        else:
            own.append(line)
        last = level
    return "\n".join(own).strip(), [(level, "\n".join(lines)) for level, lines in passages if any(x.strip() for x in lines)]


def digest(passage: str) -> str | None:
    """The hash of a passage in lower case with single spaces; none for an empty one."""
    words = passage.lower().split()
    return hashlib.md5(" ".join(words).encode("utf-8", "replace")).hexdigest() if words else None


def units(own: str) -> list[str]:
    """The hashes under which a message can be quoted: as a whole, and by paragraph."""
    return sorted({d for part in [own, *re.split(r"\n\s*\n", own)] if (d := digest(part))})


def parts(passage: str) -> dict[str, int]:
    """The hashes by which a passage is looked for, with their words: as a whole, and by paragraph."""
    return {d: len(part.split()) for part in [*re.split(r"\n\s*\n", passage), passage] if (d := digest(part))}


def _threads(edges: DataFrame) -> DataFrame:
    """(conv, turn, root, depth, place) from (conv, turn, parent), where parents are earlier turns: the message above all
    others, the steps up to it, and the place when every message is followed by its replies, by turn, each with its own
    replies behind it.

    A walk around a thread enters every message and leaves it after its replies. The step before entering one is leaving
    the reply beside it, else entering its parent; the step before leaving it is leaving its last reply, else entering it.
    Messages entered on the way back to the root count the place, and those left again are taken off for the depth. The
    way is followed from everywhere at once by pointer doubling: n rounds settle conversations of 2 ** n steps, and later
    rounds are without them. Every step is the step before one other alone, so a message of many replies is no hot key.
    """
    replies = edges.where("parent IS NOT NULL").select("conv", "turn", "parent")
    beside = last_before(replies.withColumn("_group", F.concat_ws("|", "conv", "parent")), "_group", ["turn"], F.col("turn"), "_beside").select("conv", "turn", "_beside")
    last = replies.groupBy("conv", F.col("parent").alias("turn")).agg(F.max("turn").alias("_last"))
    sizes = edges.groupBy("conv").agg((2 * F.count("*")).alias("size"))
    messages = edges.select("conv", "turn", "parent").join(beside, ["conv", "turn"], "left").join(last, ["conv", "turn"], "left").join(sizes, "conv")
    step = lambda leaving, to, to_leaving, done: F.struct(F.lit(leaving).alias("leaving"), to.alias("to"), to_leaving.alias("to_leaving"), done.alias("done"))
    entered = step(False, F.coalesce("_beside", "parent", "turn"), F.col("_beside").isNotNull(), F.col("parent").isNull())
    left = step(True, F.coalesce("_last", "turn"), F.col("_last").isNotNull(), F.lit(False))
    counts = {"depth": F.when(F.col("done"), 0).when(F.col("to_leaving"), -1).otherwise(1).cast("long"), "place": F.when(F.col("done") | F.col("to_leaving"), 0).otherwise(1).cast("long")}
    state = cut(messages.select("conv", "turn", "size", F.inline(F.array(entered, left))).withColumns(counts))
    longest = state.agg(F.max("size")).first()[0] or 0
    settled, reach = state.where("NOT leaving AND size <= 1"), 1
    while reach < longest:
        # what has come to the root stays as it is, and is its own partner
        ahead = state.select("conv", F.col("turn").alias("_turn"), F.col("leaving").alias("_leaving"), *[F.col(c).alias(f"_{c}") for c in ("to", "to_leaving", "done", "depth", "place")])
        here = state.withColumns({"_turn": F.when(F.col("done"), F.col("turn")).otherwise(F.col("to")), "_leaving": F.when(F.col("done"), F.col("leaving")).otherwise(F.col("to_leaving"))})
        sums = [F.when(F.col("done"), F.col(c)).otherwise(F.col(c) + F.col(f"_{c}")).alias(c) for c in ("depth", "place")]
        state = cut(here.join(ahead, ["conv", "_turn", "_leaving"]).select("conv", "turn", "size", "leaving", F.col("_to").alias("to"), F.col("_to_leaving").alias("to_leaving"), F.col("_done").alias("done"), *sums))
        reach *= 2
        settled = settled.unionByName(state.where(F.expr("NOT leaving") & (F.col("size") <= reach)))
        state = state.where(F.col("size") > reach)
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return settled.select("conv", "turn", F.col("to").alias("root"), "depth", "place").coalesce(parts)  # unions add up their partitions


def link_quotes(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Messages without their quotes, each with the message that it answers.

    A quoted passage is linked to the latest earlier message of its conversation that has it, as a whole or as a
    paragraph, up to case and white space; if none has it, then by the longest of its paragraphs that one has. The parent
    is the message of the outermost linked passage (the latest, if several). Root, depth and place follow from parents:
    ordered by (conv_id, root, place), messages are conversations in reply order, each message followed by its replies.
    Conversations are linked inside alone.

    Returns conv_id, turn, role, text (own text alone), n_levels (deepest quote), n_quotes (passages), n_linked, parent,
    root, depth and place (from 0 in the thread of a root), under those names. Null and empty texts are messages without
    quotes that nobody can quote. Without conversation or turn a message isn't linked, and its root is its turn. Equal messages of one turn are all kept, with
    the links of the turn. An empty table gives an empty result. Other columns are left out.
    """
    base = df.select(F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    schema = "conv long, turn long, role string, text string, levels array<int>, passages array<struct<hash:string,words:int,at:int,level:int,run:string>>, units array<string>"

    kind = pa.struct([("hash", pa.string()), ("words", pa.int32()), ("at", pa.int32()), ("level", pa.int32()), ("run", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parsed = [parse(t.as_py()) for t in batch.column(3)]
            levels = [[level for level, p in q if digest(p)] for _, q in parsed]
            hashes = [[{"hash": h, "words": n, "at": i, "level": level, "run": d} for i, (level, p) in enumerate(q) if (d := digest(p)) for h, n in parts(p).items()] for _, q in parsed]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(3)), pa.array([own for own, _ in parsed], pa.string()), pa.array(levels, pa.list_(pa.int32())), pa.array(hashes, pa.list_(kind)), pa.array([units(own) for own, _ in parsed], pa.list_(pa.string()))], names=["conv", "turn", "role", "text", "levels", "passages", "units"])

    messages = cut(base.mapInArrow(run, schema))
    known = messages.where(F.col("conv").isNotNull() & F.col("turn").isNotNull())
    quoted = known.select("conv", "turn", F.inline("passages")).groupBy("conv", "turn", "hash", "words", "at", "level", "run").agg(F.count("*").alias("_same")).withColumn("original", F.lit(0))
    # only hashes that somebody quotes in the conversation matter
    wanted = quoted.select("conv", "hash").distinct()
    sources = known.select("conv", "turn", F.explode("units").alias("hash")).join(wanted, ["conv", "hash"], "left_semi").select("conv", "turn", "hash", F.lit(1).alias("original")).distinct()
    events = quoted.unionByName(sources, allowMissingColumns=True).withColumn("_group", F.concat_ws("|", "conv", "hash"))
    found = last_before(events, "_group", ["turn", "original"], F.when(F.col("original") == 1, F.col("turn")), "_parent").where("original = 0 AND _parent IS NOT NULL")
    found = found.groupBy("conv", "turn", "at", "level", "run").agg(F.min_by("_parent", F.struct(-F.col("words"), -F.col("_parent"))).alias("_parent"), F.max("_same").alias("_same"))
    linked = found.groupBy("conv", "turn").agg(F.min_by("_parent", F.struct("level", -F.col("_parent"))).alias("parent"), F.sum("_same").alias("_linked"))
    copies = known.groupBy("conv", "turn").agg(F.count("*").alias("_copies"))
    edges = cut(copies.join(linked, ["conv", "turn"], "left"))
    threads = _threads(edges).join(edges.select("conv", "turn", "parent", (F.col("_linked") / F.col("_copies")).cast("long").alias("_linked")), ["conv", "turn"])
    out = messages.join(threads, ["conv", "turn"], "left")
    levels = F.coalesce(F.array_max("levels"), F.lit(0)).alias("n_levels")
    return out.select(
        F.col("conv").alias("conv_id"), "turn", "role", "text", levels, F.size("levels").alias("n_quotes"), F.coalesce("_linked", F.lit(0)).alias("n_linked"), "parent", F.coalesce("root", "turn").alias("root"), F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("place", F.lit(0)).alias("place")
    )


def as_mail(df: DataFrame) -> DataFrame:
    """Messages as mail programs write them: each quotes the one before it, which quotes the one before that.

    df has conv_id, turn, role and text; of several messages of one turn the largest text is quoted.
    """
    known = df.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    before = lambda k: known.groupBy("conv_id", (F.col("turn") + k).alias("turn")).agg(F.max("text").alias(f"_t{k}"))
    rows = df.select("conv_id", "turn", "role", "text").join(before(1), ["conv_id", "turn"], "left").join(before(2), ["conv_id", "turn"], "left")
    mark = lambda c, sign: F.concat(F.lit(sign), F.regexp_replace(c, "\n", f"\n{sign}"))
    quote = F.concat(F.lit("\n\nOn an earlier day somebody wrote:\n"), mark(F.col("_t1"), "> "), F.coalesce(F.concat(F.lit("\n> Somebody else wrote:\n"), mark(F.col("_t2"), "> > ")), F.lit("")))
    return rows.select("conv_id", "turn", "role", F.concat(F.coalesce("text", F.lit("")), F.coalesce(quote, F.lit(""))).alias("text"))
