"""Trie of all prefixes of conversations, built by van Emde Boas recursion.

A turn is a 24-byte token (16 bytes of a hash of role and text, 8 bytes of the text's
length); a node of the trie is named by a 16-byte hash.

*Down.*  A set of sequences of at most 2h turns under one root is cut at depth h.  The first
halves make the upper trie under the same root; a sequence that goes on names its cut
prefix, hash(root, the h tokens), and its rest joins the lower forest under that name.
Upper tries and lower forests of every root are pieces of the same shape, so one
step cuts all of them at once, and after log2(depth) steps a piece is one turn: its node is
hash(root, token).  The cuts lie at fixed multiples of powers of two, so equal prefixes
get equal names whatever follows them.  Conversations cross the network in rows of at
most ``block`` turns, which are cut inside the row; across the rows of a longer conversation the same
recursion runs on a table, with the names of whole halves made first, bottom up.

*Up.*  Subtree totals are grafted in the opposite order: with the totals inside pieces of h
levels known, the lower forest under a cut prefix at depth m adds its sums to the nodes of that
prefix at depths m-h+1 .. m, and pieces of 2h levels are whole.  That is log2(depth)
rounds whatever the shape of the trie, and a node meets at most log2(depth) lower forests' sums a path.

A node is kept as (smallest member, depth), which is unique.  No conversation is held by one
task: turns are numbered by a range-sorted index, and lookups by conversation or
node send hot keys by a bounded broadcast.  A node's digest of member ids is sequential by
definition, so sorted pieces of at most 4,096 ids are rendered everywhere and only hashed in order.

Defined cases: rows without conv_id belong to no conversation and are left out; null role or
text is empty; turns of one conversation with the same ``turn`` are ordered by role, then by the
SHA-256 of role and text (repeated rows are turns of their own); null turns come first; without
conversations there is no node, not even a root.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.indexing import with_row_index
from ..operators.prep import join_by_key
from .common import written

NAME, TOKEN = 16, 24
#: Turns of a conversation in one row.
BLOCK = 1024
#: Steps of a path that share a join key while totals are grafted.
PATH_BLOCK = 4096
#: Ids rendered together for a node's digest: 2 ** ID_BITS at most.
ID_BITS = 12


def _name(*parts: Column) -> Column:
    return F.substring(F.unhex(F.sha2(F.concat(*parts), 256)), 1, NAME)


def _root() -> Column:
    return F.lit(bytes(NAME))


def _token(role: Column, text: Column) -> Column:
    """Hash of role and text, told apart by the role's length, then the text's bytes as 8 bytes."""
    said = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")
    return F.concat(_name(said), F.unhex(F.lpad(F.hex(F.octet_length(text).cast("long")), 16, "0")))


def _token_bytes(token: Column) -> Column:
    return F.conv(F.hex(F.substring(token, NAME + 1, 8)), 16, 10).cast("long")


def ordered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns: conv_id, pos from 0, token; conversations: conv_id, n).  Written tables."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), _token(role, text).alias("token"))
    idx = with_row_index(rows, [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("token")], "at")
    idx = idx.select("conv_id", "token", "at")
    convs = written(idx.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first")), "trie-convs")
    total = convs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    turns = join_by_key(idx, convs, ["conv_id"], "n", total).select("conv_id", (F.col("at") - F.col("first")).alias("pos"), "token")
    return written(turns, "trie-turns"), convs.select("conv_id", "n")


def share_heads(turns: DataFrame, convs: DataFrame, every: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt as branches of common openings: conversation c takes the first h
    turns of conversation c - c % ``every`` (all if fewer, none if absent) and goes on with its own turns after
    its first h; h = crc32 of c in decimal, modulo ``heads``."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("long")
    plan = convs.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % every).alias("base"), h.alias("h"))
    lens = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    plan = plan.join(lens, "base", "left").select("conv_id", "n", "base", "h", F.least("h", F.coalesce("n_base", F.lit(0))).alias("taken"))
    plan = written(plan, "trie-plan")
    total = plan.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    own = join_by_key(turns, plan.select("conv_id", "n", "h", "taken"), ["conv_id"], "n", total).where("pos >= h")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "token")
    opening = turns.where(F.col("pos") < heads).withColumnRenamed("conv_id", "base")
    lent = plan.join(opening, "base").where("pos < h").select("conv_id", "pos", "token")
    n = (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n")
    return own.unionByName(lent), plan.select("conv_id", n)


def _powers(limit: int) -> list[int]:
    """1, 2, 4, ... below ``limit``."""
    out = [1]
    while out[-1] * 2 < limit:
        out.append(out[-1] * 2)
    return out if limit > 1 else []


def _block_roots(blocks: DataFrame, n_blocks: int) -> DataFrame:
    """Names of the cut prefixes at which the rows of long conversations start
    (conv_id, blk, root): names of whole halves bottom up, then roots top down."""
    long = blocks.where("blk > 0").select("conv_id").distinct()
    level = blocks.join(long, "conv_id", "left_semi").select("conv_id", "blk", _name(F.col("seq")).alias("seg"))
    levels = []
    for _ in _powers(n_blocks):
        level = written(level, "trie-halves")
        levels.append(level)
        pair = F.shiftright("blk", 1)
        left = F.max(F.when(F.col("blk") % 2 == 0, F.col("seg")))
        right = F.max(F.when(F.col("blk") % 2 == 1, F.col("seg")))
        both = level.groupBy("conv_id", pair.alias("up")).agg(left.alias("l"), right.alias("r"))
        level = both.select("conv_id", F.col("up").alias("blk"), F.when(F.col("r").isNull(), F.col("l")).otherwise(_name(F.col("l"), F.col("r"))).alias("seg"))
    roots = level.select("conv_id", "blk", _root().alias("root"))
    for below in reversed(levels):
        up = F.shiftright("blk", 1)
        left = F.max(F.when(F.col("blk") % 2 == 0, F.col("seg")))
        halves = below.groupBy("conv_id", up.alias("blk")).agg(left.alias("l"), F.count(F.lit(1)).alias("k"))
        got = roots.join(halves, ["conv_id", "blk"])
        two = F.array(F.struct((F.col("blk") * 2).alias("blk"), F.col("root")),
                      F.struct((F.col("blk") * 2 + 1).alias("blk"), _name(F.col("root"), F.col("l")).alias("root")))
        roots = got.select("conv_id", F.explode(F.slice(two, F.lit(1), F.col("k").cast("int"))).alias("x")).select("conv_id", "x.blk", "x.root")
    return roots


def _steps(turns: DataFrame, longest: int, block: int) -> DataFrame:
    """conv_id, depth, name of the prefix (and its turn's bytes), for every prefix of every sequence."""
    listed = F.array_sort(F.collect_list(F.struct("pos", F.hex("token").alias("t"))))
    blocks = (turns.groupBy("conv_id", F.floor(F.col("pos") / block).alias("blk"))
              .agg(F.unhex(F.array_join(F.transform(listed, lambda s: s["t"]), "")).alias("seq")))
    start = (F.col("blk") * block).alias("start")
    n_blocks = -(-longest // block)
    if n_blocks > 1:
        blocks = written(blocks, "trie-blocks")
        pieces = blocks.join(_block_roots(blocks, n_blocks), ["conv_id", "blk"], "left").select(
            "conv_id", start, F.coalesce("root", _root()).alias("root"), "seq")
    else:
        pieces = blocks.select("conv_id", start, _root().alias("root"), "seq")
    for half in reversed(_powers(min(longest, block))):
        head = F.substring(F.col("seq"), 1, TOKEN * half)
        rest = F.expr(f"substring(seq, {TOKEN * half + 1})")
        upper = F.struct(F.col("start"), F.col("root"), head.alias("seq"))
        lower = F.struct((F.col("start") + half).alias("start"), _name(F.col("root"), head).alias("root"), rest.alias("seq"))
        cut = F.when(F.octet_length("seq") > TOKEN * half, F.array(upper, lower)).otherwise(F.array(upper))
        pieces = pieces.select("conv_id", F.explode(cut).alias("x")).select("conv_id", "x.start", "x.root", "x.seq")
    return pieces.select("conv_id", (F.col("start") + 1).alias("depth"), _name(F.col("root"), F.col("seq")).alias("name"),
                         _token_bytes(F.col("seq")).alias("bytes"))


def _digest_runs(batches):
    """SHA-256 of each node's id pieces, which arrive in order."""
    key, h = None, None
    for pdf in batches:
        out = []
        for node, depth, ids in zip(pdf["conv_id"], pdf["depth"], pdf["ids"]):
            if key != (node, depth):
                if key is not None:
                    out.append((*key, h.hexdigest()))
                key, h = (node, depth), hashlib.sha256()
            else:
                h.update(b",")
            h.update(ids.encode())
        yield pd.DataFrame(out, columns=["conv_id", "depth", "ends_sha256"])
    if key is not None:
        yield pd.DataFrame([(*key, h.hexdigest())], columns=["conv_id", "depth", "ends_sha256"])


def _ends(ended: DataFrame) -> DataFrame:
    """``ended``: conv_id and depth of a node, member.  Digest of the members' decimal ids in order."""
    ids = F.transform(F.array_sort(F.collect_list("member")), lambda v: v.cast("string"))
    pieces = ended.groupBy("conv_id", "depth", F.shiftright("member", ID_BITS).alias("part")).agg(F.array_join(ids, ",").alias("ids"))
    ranged = pieces.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "part")
    return ranged.select("conv_id", "depth", "ids").mapInPandas(_digest_runs, "conv_id long, depth long, ends_sha256 string")


def _grafted(nodes: DataFrame, paths: DataFrame, deepest: int) -> DataFrame:
    """Subtree totals of every node but the root.  ``nodes``: conv_id, depth, parent_conv_id, n_leaves
    and saved of the node alone; ``paths``: conv_id, depth, rep (the node there)."""
    totals = nodes.select("conv_id", "depth", "parent_conv_id", "n_leaves", "saved")
    for h in _powers(deepest):
        forest = (totals.where((F.col("depth") - 1) % (2 * h) == h)
                  .groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("m"))
                  .agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved")))
        part = min(h, PATH_BLOCK)
        last = F.floor((F.col("m") - 1) / part)
        cuts = forest.select("*", F.explode(F.sequence(last - (h // part - 1), last)).alias("part"))
        upper = paths.where(F.floor((F.col("depth") - 1) / h) % 2 == 0).withColumn("part", F.floor((F.col("depth") - 1) / part))
        gains = (cuts.join(upper, ["conv_id", "part"])
                 .groupBy(F.col("rep").alias("conv_id"), "depth")
                 .agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
                 .withColumn("parent_conv_id", F.lit(None).cast("long")))
        totals = written(totals.unionByName(gains).groupBy("conv_id", "depth").agg(
            F.max("parent_conv_id").alias("parent_conv_id"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved")), "trie-totals")
    return totals


def trie(turns: DataFrame, convs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per node of the trie of all prefixes, root included: conv_id (smallest member),
    depth, parent_conv_id, n_convs, n_children, n_leaves and saved_tokens of the subtree, ends_sha256.

    ``turns``: conv_id, pos (0, 1, ... without gaps), token; ``convs``: conv_id, n (turns, also 0).
    ``block`` is a power of two."""
    whole = convs.agg(F.count(F.lit(1)), F.min("conv_id"), F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_convs, least, deepest, n_turns = whole
    steps = written(_steps(turns, deepest, block), "trie-steps")
    named = steps.groupBy("name").agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("rep"), F.max("bytes").alias("bytes"))
    paths = join_by_key(steps.select("conv_id", "depth", "name"), named, ["name"], "n_convs", n_turns)
    paths = written(paths.select("conv_id", "depth", "rep", "n_convs", "bytes"), "trie-paths")
    own = paths.where(F.col("conv_id") == F.col("rep")).select("conv_id", "depth", "n_convs", "bytes")
    above = paths.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("rep").alias("up"))
    nodes = own.join(above, ["conv_id", "depth"], "left").withColumn("parent_conv_id", F.coalesce("up", F.lit(least).cast("long"))).drop("up")
    nodes = written(nodes, "trie-nodes")
    kids = nodes.groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    root = convs.groupBy().agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.select("conv_id", F.lit(0).cast("long").alias("depth"), "n_convs", F.lit(0).cast("long").alias("bytes"),
                       F.lit(None).cast("long").alias("parent_conv_id"))
    known = nodes.unionByName(root).join(kids, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    known = written(known.withColumn("n_leaves", (F.col("n_children") == 0).cast("long"))
                    .withColumn("saved", (F.col("n_convs") - 1) * F.col("bytes")), "trie-known")
    totals = _grafted(known.where("depth > 0"), paths.select("conv_id", "depth", "rep"), deepest)
    top = totals.where("depth = 1").groupBy().agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
    top = top.select(F.lit(least).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), "n_leaves", "saved")
    totals = totals.select("conv_id", "depth", "n_leaves", "saved").unionByName(top)
    ended = (convs.select(F.col("conv_id").alias("member"), F.col("n").alias("depth"))
             .join(paths.select(F.col("conv_id").alias("member"), "depth", "rep"), ["member", "depth"], "left")
             .select(F.coalesce("rep", F.lit(least).cast("long")).alias("conv_id"), "depth", "member"))
    out = known.drop("n_leaves", "saved").join(totals, ["conv_id", "depth"], "left").join(_ends(ended), ["conv_id", "depth"], "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
                      F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"),
                      F.coalesce("saved", F.lit(0)).cast("long").alias("saved_tokens"),
                      F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def node_turns(nodes: DataFrame, turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """Role and text of every node's last turn (null at the root): the turn at the node's depth
    of its smallest member, found by its token among the conversations' turns."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = conversations.select(_token(role, text).alias("token"), role.alias("role"), text.alias("text")).dropDuplicates(["token"])
    at = turns.select("conv_id", (F.col("pos") + 1).alias("depth"), "token")
    return nodes.join(at, ["conv_id", "depth"], "left").join(said, "token", "left").drop("token")


def conversation_trie(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """The trie of ``conversations`` (conv_id, turn, role, text) as they are."""
    return trie(*ordered_turns(conversations), block)
