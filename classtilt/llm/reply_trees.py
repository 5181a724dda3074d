"""Chat formatting: reply trees to root-to-leaf paths, ranked by score, each written as one conversation.

Paths come from iterative self-joins over the reply links. Each round doubles the distance: round k knows for every
message its ancestor 2 ** k links up and the score collected on the way, so a tree of depth d takes log2(d) rounds, and
what a round carries is ids and scores, never texts. Chosen leaves then walk up by the same tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from classtilt.llm.common import whole
from classtilt.session import cut

#: The template's control strings: <s> </s> [INST] [/INST] <<SYS>> <</SYS>> <<ROLE hex>> <</ROLE>>.
CONTROL = r"/?(?:s>|INST\]|SYS>|ROLE[ >])"
PIECE = r"(?s)<s> .*? </s>|\[INST\] .*? \[/INST\]|<<SYS>> .*? <</SYS>>|<<ROLE [0-9A-F]*>> .*? <</ROLE>>"


def escaped(text: Column) -> Column:
    """A text in which no control string is left: a backslash follows the bracket, one more where some are there."""

    return F.regexp_replace(text, rf"([<\[])(\\*)({CONTROL})", r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({CONTROL})", "$1$2$3")


def _opening(role: Column) -> Column:
    return (
        F.when(role == "assistant", "<s> ")
        .when(role == "user", "[INST] ")
        .when(role == "system", "<<SYS>> ")
        .otherwise(F.concat(F.lit("<<ROLE "), F.hex(F.encode(role, "UTF-8")), F.lit(">> ")))
    )


def _closing(role: Column) -> Column:
    return (
        F.when(role == "assistant", " </s>")
        .when(role == "user", " [/INST]")
        .when(role == "system", " <</SYS>>")
        .otherwise(" <</ROLE>>")
    )


def reply_paths(messages: DataFrame, paths_per_tree: int | None = 1) -> DataFrame:
    """Chosen root-to-leaf paths of reply trees: path_id (the leaf), tree_id, rank, turn, msg_id.

    ``messages`` has msg_id (unique, of any type with an order), parent_id (null at a root), tree_id and score (null: 0). A parent that is not
    there makes a root. Branches are ranked in their tree by the sum of the scores on the path, then by the smaller leaf; the
    best ``paths_per_tree`` are chosen, all if None. Messages on a cycle of parents, or below one, have no root and
    lie on no path. Rows that repeat a msg_id count once (the smallest parent, tree and score), null msg_ids not at all.
    """

    rows = messages.filter("msg_id is not null").groupBy("msg_id").agg(
        F.min(F.struct("parent_id", "tree_id", "score")).alias("_m")
    )
    rows = rows.select("msg_id", "_m.parent_id", "_m.tree_id", F.coalesce("_m.score", F.lit(0.0)).cast("double").alias("score"))
    there = rows.select(F.col("msg_id").alias("_p"))
    # Roots look for themselves, so that their null parents do not meet in one task.
    named = rows.join(there, F.coalesce("parent_id", "msg_id") == F.col("_p"), "left")
    nodes = cut(
        named.select(
            "msg_id",
            "tree_id",
            F.when(F.col("parent_id").isNotNull(), F.col("_p")).alias("up"),
            F.lit(1).cast("long").alias("links"),
            F.col("score").alias("sum"),
        )
    )
    # A round works on the messages that have not reached their root; the others wait in ``done``.
    jumps, done = [nodes.filter("up is not null")], nodes.filter("up is null")
    most = nodes.count()
    while not jumps[-1].isEmpty():
        if 1 << len(jumps) > 2 * most + 2:
            break  # only cycles are left
        last = jumps[-1]
        ahead = last.unionByName(done).select(
            F.col("msg_id").alias("_id"), F.col("up").alias("_up"), F.col("links").alias("_links"), F.col("sum").alias("_sum")
        )
        reached = cut(
            last.join(ahead, last["up"] == ahead["_id"]).select(
                "msg_id",
                "tree_id",
                F.col("_up").alias("up"),
                (F.col("links") + F.col("_links")).alias("links"),
                (F.col("sum") + F.col("_sum")).alias("sum"),
            )
        )
        jumps.append(reached.filter("up is not null"))
        done = done.unionByName(reached.filter("up is null"))
    # ``done`` holds, for every message with a root, all links up to it (the root counts as one) and the whole sum.
    parents = nodes.filter("up is not null").select(F.col("up").alias("_p")).distinct()
    leaves = done.join(parents, F.col("msg_id") == F.col("_p"), "left_anti")
    order = Window.partitionBy("tree_id").orderBy(F.desc("sum"), "msg_id")
    leaves = leaves.withColumn("rank", F.row_number().over(order))
    if paths_per_tree is not None:
        leaves = leaves.filter(F.col("rank") <= paths_per_tree)
    walk = leaves.select(F.col("msg_id").alias("path_id"), "tree_id", "rank", "links", "msg_id", F.col("links").alias("turn"))
    # Every ancestor is reached once: its distance in binary says which jumps to take, the longest first.
    for k in reversed(range(len(jumps) - 1)):
        step = jumps[k].select(F.col("msg_id").alias("_id"), F.col("up").alias("_up"))
        up = walk.join(step, walk["msg_id"] == step["_id"]).select(
            "path_id", "tree_id", "rank", "links", F.col("_up").alias("msg_id"), (F.col("turn") - (1 << k)).alias("turn")
        )
        walk = cut(walk.unionByName(up))
    return walk.select("path_id", "tree_id", "rank", "turn", "msg_id")


def format_paths(messages: DataFrame, paths: DataFrame) -> DataFrame:
    """One conversation per path: path_id, tree_id, rank, formatted, loss_spans (0-based start, length; in characters).

    ``messages`` has msg_id, role and text (null: empty). Control strings inside texts are escaped; the spans cover the
    assistant's texts only. A conversation is one row by nature, so its size is that of its longest path.
    """

    texts = messages.filter("msg_id is not null").groupBy("msg_id").agg(
        F.min(F.struct(whole(F.col("role")).alias("role"), whole(F.col("text")).alias("text"))).alias("_t")
    )
    turns = paths.join(texts, "msg_id").select(
        "path_id", "tree_id", "rank", F.struct("turn", F.col("_t.role").alias("role"), escaped(F.col("_t.text")).alias("text")).alias("_t")
    )
    grouped = turns.groupBy("path_id", "tree_id", "rank").agg(F.sort_array(F.collect_list("_t")).alias("_turns"))
    pieces = F.transform("_turns", lambda t: F.concat(_opening(t["role"]), t["text"], _closing(t["role"])))
    sizes = F.transform(
        "_turns",
        lambda t: F.struct(
            (t["role"] == "assistant").alias("loss"),
            F.char_length(_opening(t["role"])).alias("head"),
            F.char_length(t["text"]).alias("size"),
            F.char_length(_closing(t["role"])).alias("tail"),
        ),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def follow(seen: Column, piece: Column) -> Column:
        span = F.struct((seen["at"] + piece["head"]).alias("start"), piece["size"].alias("length"))
        return F.struct(
            (seen["at"] + piece["head"] + piece["size"] + piece["tail"]).alias("at"),
            F.when(piece["loss"], F.array_append(seen["spans"], span)).otherwise(seen["spans"]).alias("spans"),
        )

    return grouped.select(
        "path_id",
        "tree_id",
        "rank",
        F.array_join(pieces, "").alias("formatted"),
        F.aggregate(sizes, start, follow)["spans"].alias("loss_spans"),
    )


def read_back(formatted: Column) -> Column:
    """Turns (role, text) of a formatted conversation."""

    def turn(piece: Column) -> Column:
        role = (
            F.when(piece.startswith("<s>"), "assistant")
            .when(piece.startswith("[INST]"), "user")
            .when(piece.startswith("<<SYS>>"), "system")
            .otherwise(F.decode(F.unhex(F.regexp_extract(piece, r"^<<ROLE ([0-9A-F]*)>>", 1)), "UTF-8"))
        )
        inner = F.regexp_extract(piece, r"(?s)^(?:<s>|\[INST\]|<<SYS>>|<<ROLE [0-9A-F]*>>) (.*) (?:</s>|\[/INST\]|<</SYS>>|<</ROLE>>)$", 1)
        return F.struct(role.alias("role"), unescaped(inner).alias("text"))

    return F.transform(F.regexp_extract_all(formatted, F.lit(PIECE), F.lit(0)), turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """Text under the loss mask, unescaped, nothing between."""

    own = F.transform(spans, lambda s: unescaped(F.substring(formatted, s["start"] + 1, s["length"])))
    return F.array_join(own, "")


def messages_of_turns(conversations: DataFrame) -> DataFrame:
    """Linear conversations as reply trees: each row replies to the row before it by (turn, role, text).

    Returns msg_id and parent_id (structs of conv_id and row number), tree_id (conv_id), role, text and score 0. Rows that
    repeat a turn stay apart; rows with a null conv_id form one conversation.
    """

    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("_n", F.row_number().over(order).cast("long"))
    return rows.select(
        F.struct("conv_id", F.col("_n").alias("n")).alias("msg_id"),
        F.when(F.col("_n") > 1, F.struct("conv_id", (F.col("_n") - 1).alias("n"))).alias("parent_id"),
        F.col("conv_id").alias("tree_id"),
        "role",
        "text",
        F.lit(0.0).alias("score"),
    )
