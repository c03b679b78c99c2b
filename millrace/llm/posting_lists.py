"""Components of documents that share rare tokens, from posting lists.

Common to the joins that deal documents out under the rarest tokens of their sets or
signatures: postings that occur once go, the rest is a table (token, doc_id, n, pos) of
class representatives, n being what lengths are compared by and pos the token's place in
the document's global order.

Star pass: in every list, members are paired with the member that has the token earliest
in its order, filtered, verified and joined into components. This costs one pair for each
posting, and turns large groups of near copies into one component.

Rest pass: pairs of one list whose members are still in different components, within the
bands of lengths that a partner can have. Lists of a band with more than LIST members are
dealt over cells, so that no task holds more than LIST by LIST of their pairs. A pair
inside one component can't change a component, so no link is lost. Pairs that a join has
settled by other means (documents with one hub) are left out.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .graph import components
from .shared import Shelf

#: A posting list estimated at one of HOT_PART documents or more, and 2**HOT_LEVEL at least, is dealt over SALTS tasks.
HOT_PART, HOT_LEVEL, SALTS = 1024, 12, 64
#: Lengths of a band of the rest pass differ by this factor.
BAND = 1.07
#: Members of a list and band that one cell of the rest pass pairs.
LIST = 2048
POSTING = "token long, doc_id long, n int, pos int"


@dataclass(frozen=True)
class Rules:
    """What a link demands of a pair: lengths that fit, the lengths that a posting's partner can have, and filters by place and number of common tokens."""

    close: Callable[[Column, Column], Column]
    between: Callable[[DataFrame], tuple[Column, Column]]
    plausible: Callable[[DataFrame], DataFrame]


def hot_level(documents: int) -> int:
    return max(HOT_LEVEL, (documents // HOT_PART).bit_length())


def repeated(prefixes: DataFrame, hot: int) -> DataFrame:
    """The rows whose token has another row: dealt by token, sorted within the task, neighbours compared in one stream.

    Lists from level `hot` on are dealt over several tasks; their rows all stay here, and
    those that are alone after all go where lists are counted.
    """

    def run(batches):
        held, held_token, held_kept = None, None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            token = batch.column("token").to_numpy()
            same = token[1:] == token[:-1]
            keep = np.append(same, False) | np.append(token[0] == held_token if held is not None else False, same)
            keep |= (token.view(np.uint64) >> np.uint64(58)) >= hot
            if held is not None and not held_kept and token[0] == held_token:
                yield held
            yield batch.filter(pa.array(keep))
            held, held_token, held_kept = batch.slice(batch.num_rows - 1), token[-1], bool(keep[-1])

    salt = F.when(F.shiftrightunsigned("token", 58) >= hot, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).otherwise(0)
    rows = prefixes.repartition("token", salt).sortWithinPartitions("token")
    return rows.mapInArrow(run, POSTING)


def classes_of(signed: DataFrame, shelf: Shelf) -> DataFrame:
    """(sig_a, sig_b, n, rep, copies): documents with equal sets, stood for by their smallest id."""
    rows = signed.where("n > 0 and doc_id is not null").groupBy("sig_a", "sig_b", "n")
    return shelf.put(rows.agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")


def texts_of(texts: DataFrame, pairs: DataFrame, shelf: Shelf, label: str) -> DataFrame:
    """The rows of `texts` whose doc_id is in a pair (x, y), and few others, which drop out of the joins behind.

    While a broadcast filter has room for the ids, it passes them over without a shuffle of
    texts; with more ids than that, texts are joined with them.
    """
    sc = texts.sparkSession.sparkContext
    ids = shelf.put(pairs.select(F.col("x").alias("doc_id")).unionByName(pairs.select(F.col("y").alias("doc_id"))).distinct(), f"{label}_ids")
    n = ids.count()
    if n > bloom.CAPACITY:
        return texts.join(ids, "doc_id", "left_semi")
    sent = sc.broadcast(bloom.bloom_of(ids, n))

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(sent.value.has(batch.column("doc_id").to_numpy(zero_copy_only=False))))

    return texts.mapInArrow(run, texts.schema)


def _one_class(plain: DataFrame, classes: DataFrame, shelf: Shelf) -> DataFrame | None:
    """Links (x, y) between the classes of an id that stands with several texts; None where no id does."""
    several = shelf.put(plain.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("doc_id"), "several")
    if several.isEmpty():
        return None
    own = plain.join(several, "doc_id", "left_semi").join(classes, ["sig_a", "sig_b", "n"]).select("doc_id", "rep").distinct()
    own = own.unionByName(several.join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id").select("doc_id", F.col("doc_id").alias("rep"))).distinct()
    own = shelf.put(own, "own")
    least = shelf.put(own.groupBy("doc_id").agg(F.min("rep").alias("y")), "own_least")
    return shelf.put(own.join(least, "doc_id").where("rep <> y").select(F.col("rep").alias("x"), "y").distinct(), "own_links")


def _band(n):
    return F.floor(F.log(n.cast("double")) / float(np.log(BAND))).cast("int")


def _star_pairs(postings: DataFrame, rules: Rules, shelf: Shelf) -> DataFrame:
    # The hub is the member with the fewest rarer tokens: of near copies, the one nearest to their original.
    hub = F.min(F.struct("pos", "doc_id", "n")).alias("hub")
    lists = postings.groupBy("token").agg(F.count(F.lit(1)).alias("m"), hub).where("m > 1").drop("m")
    # Stored, so that the join deals out both sides anew and can split long lists.
    lists = shelf.put(lists, "lists")
    star = postings.join(lists, "token").where("doc_id <> hub.doc_id").select(
        F.col("doc_id").alias("x"), F.col("n").alias("nx"), F.col("pos").alias("px"), F.col("hub.doc_id").alias("y"), F.col("hub.n").alias("ny"), F.col("hub.pos").alias("py"),
    ).where(rules.close(F.col("nx"), F.col("ny")))
    star = shelf.put(rules.plausible(star), "star")
    shelf.drop("lists")
    return star


def _rest_pairs(postings: DataFrame, joined: DataFrame, hubs: DataFrame | None, rules: Rules, shelf: Shelf) -> DataFrame:
    # Only lists with members of more than one component are left, and of their pairs only those between components.
    member = postings.join(joined.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("c", F.coalesce("component", "doc_id")).drop("component")
    if hubs is not None:
        member = member.join(hubs, "doc_id", "left").withColumn("hub", F.coalesce("hub", "doc_id"))
    else:
        member = member.withColumn("hub", F.col("doc_id"))
    member = shelf.put(member.withColumn("band", _band(F.col("n"))), "members")
    shelf.drop("postings")
    spread = member.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min_by("c", "doc_id").alias("main")).where("lo < hi").select("token", "main")
    spread = shelf.put(spread, "spread")
    member = shelf.put(member.join(spread, "token"), "member")
    shelf.drop("members", "spread")
    low, high = rules.between(member)
    member = member.withColumns({"low": low, "high": high})
    odd = member.where("c <> main and low <= high").withColumn("band", F.explode(F.sequence(_band(F.col("low")), _band(F.col("high")))))
    odd = odd.select("token", "band", F.col("doc_id").alias("x"), F.col("n").alias("nx"), F.col("pos").alias("px"), F.col("c").alias("cx"), F.col("hub").alias("hx"), F.col("low").alias("lx"), F.col("high").alias("gx"))
    other = member.select("token", "band", F.col("doc_id").alias("y"), F.col("n").alias("ny"), F.col("pos").alias("py"), F.col("c").alias("cy"), F.col("hub").alias("hy"), F.col("low").alias("ly"), F.col("high").alias("gy"), (F.col("c") == F.col("main")).alias("in_main"))
    # A long list of a band is cut both ways: each side's share of a cell is LIST rows, and every pair has one cell.
    sizes = [rows.groupBy("token", "band").agg(F.ceil(F.count(F.lit(1)) / LIST).alias(name)) for rows, name in ((odd, "odd_cells"), (other, "other_cells"))]
    long = shelf.put(sizes[0].join(sizes[1], ["token", "band"]).where("odd_cells > 1 and other_cells > 1"), "long")
    if long.isEmpty():
        cross = odd.join(other, ["token", "band"])
    else:
        def dealt(rows: DataFrame, own: str, doc: str) -> DataFrame:
            """Rows of long lists in a cell of their own side, beside every cell of the other side."""
            rows = rows.join(long, ["token", "band"], "left").withColumns({c: F.coalesce(c, F.lit(1).cast("long")) for c in ("odd_cells", "other_cells")})
            facing = "other_cells" if own == "odd_cells" else "odd_cells"
            rows = rows.withColumn(f"{own}_at", F.pmod(F.xxhash64(doc), own)).withColumn(f"{facing}_at", F.explode(F.sequence(F.lit(0).cast("long"), F.col(facing) - 1)))
            return rows.drop("odd_cells", "other_cells")

        cross = dealt(odd, "odd_cells", "x").join(dealt(other, "other_cells", "y"), ["token", "band", "odd_cells_at", "other_cells_at"])
    fits = F.col("ny").between(F.col("lx"), F.col("gx")) & F.col("nx").between(F.col("ly"), F.col("gy"))
    cross = cross.where((F.col("cx") != F.col("cy")) & (F.col("hx") != F.col("hy")) & (F.col("in_main") | (F.col("x") < F.col("y"))) & fits)
    least, most = [F.when(F.col("x") < F.col("y"), F.struct(F.col(f"{a}").alias("id"), F.col(f"n{a}").alias("n"), F.col(f"p{a}").alias("p"))).otherwise(F.struct(F.col(f"{b}").alias("id"), F.col(f"n{b}").alias("n"), F.col(f"p{b}").alias("p"))) for a, b in (("x", "y"), ("y", "x"))]
    cross = cross.select(least.alias("l"), most.alias("h")).select(F.col("l.id").alias("x"), F.col("l.n").alias("nx"), F.col("l.p").alias("px"), F.col("h.id").alias("y"), F.col("h.n").alias("ny"), F.col("h.p").alias("py"))
    rest = shelf.put(rules.plausible(cross), "rest")
    shelf.drop("member", "long")
    return rest


def linked(plain: DataFrame, classes: DataFrame, postings: DataFrame, rules: Rules, verified: Callable[[DataFrame, str], DataFrame], shelf: Shelf, settled: Callable[[DataFrame], tuple[DataFrame, DataFrame]] | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of `plain` (doc_id, n, sig_a, sig_b).

    `postings` is stored under that name; `verified` gives the pairs (x, y) that link, stored,
    of pairs that passed the filters. `settled` may give, from the star pass's components
    (node, component), a hub for documents (doc_id, hub) and all links between documents of
    one hub that are in different components, both stored. Rows with one id are one document that links where any
    of its texts does, all in one component; rows without an id have component null.
    """
    def grouped(links: DataFrame, label: str) -> DataFrame:
        return components(links.select(F.col("x").alias("a"), F.col("y").alias("b")), shelf, label)

    links = verified(_star_pairs(postings, rules, shelf), "star")
    if (same := _one_class(plain, classes, shelf)) is not None:
        links = links.unionByName(same)
    joined = shelf.put(grouped(links, "first"), "joined")
    near, hubs = (None, None) if settled is None else settled(joined)
    rest = _rest_pairs(postings, joined, hubs, rules, shelf)
    more = [x for x in (near, None if rest.isEmpty() else verified(rest, "rest")) if x is not None and not x.isEmpty()]
    if more:
        for x in more:
            links = links.unionByName(x)
        joined = shelf.put(grouped(links, "second"), "joined_again")
    group = classes.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("sig_a", "sig_b", "n", F.coalesce("component", "rep").alias("component_id"))
    out = plain.join(group, ["sig_a", "sig_b", "n"], "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    if same is not None:
        # A text without words shares the component of its id's other texts.
        one = out.where("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("one"))
        out = out.join(one, "doc_id", "left").withColumn("component_id", F.col("one"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id")
