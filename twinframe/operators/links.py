"""From near cells to linking edges, without listing every pair of a cell.

A *cell* is one hash value (with its class and bin); the *members* of a cell are the nodes that carry it. Components
need only enough edges to connect what is connected:

1. every member is tested against the pivot of its cell, and the pivots of near cells against each other;
2. components of those edges show which pairs could still matter: two nodes that already share a component never
   do, so within a cell, and between two cells, only pairs with one side outside the dominating component are left;
3. those pairs are tested, spread over tasks by salt.

Where all cells are small, as in most catalogues, their members are tested at once instead.

The edges connect exactly what the full pair list would connect. A cell with millions of alike members costs one
test per member.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinframe.operators.candidates import mask_keys
from twinframe.operators.components import connected_components, extend_components
from twinframe.session import materialise

PIVOT_ROUNDS = 6
REST_PER_NODE = 50
TASK_PAIRS = 5_000_000
SMALL_CELL = 100_000
NEW_PIVOTS = 4

Rule = Callable[[Column, Column], Column]


class Linker:
    """Tests node pairs of one node table, under one configuration or under every row of a settings grid."""

    def __init__(self, nodes: DataFrame, rule: Rule, grid: DataFrame | None = None, combos: int = 1,
                 dhash_radius: int | None = None, low_entropy: float | None = None, low_radius: int | None = None,
                 early: Rule | None = None, wide: tuple[str, ...] = ()):
        """``early`` is the part of ``rule`` that reads none of the ``wide`` columns."""
        self.nodes = nodes
        self.rule = rule
        self.grid = grid
        self.combos = combos
        self.dhash_radius = dhash_radius
        self.low_entropy = low_entropy
        self.low_radius = low_radius
        self.early = early
        self.wide = wide if early is not None else ()
        # Built once: the rule is a large expression.
        a, b = F.col("a_"), F.col("b_")
        self._passes, self._passes_early = rule(a, b), early(a, b) if early is not None else None

    def vertex(self, node: str, combo: str = "combo_id") -> Column:
        return F.col(node) * self.combos + F.col(combo)

    def test(self, ids: DataFrame, weight: Rule | None = None) -> DataFrame:
        """``(a, b[, combo_id])`` to the vertex edges that pass, with their weight where one is asked for."""
        fields = F.struct(*[c for c in self.nodes.columns if c != "node_id" and c not in self.wide])
        side = lambda name: self.nodes.select(F.col("node_id").alias(name), fields.alias(f"{name}_"))
        heavy = lambda name: self.nodes.select(
            F.col("node_id").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in self.wide])
        # A hot pivot meets many nodes: join on the many side first, then fetch the pivot.
        df = ids.filter("a <> b").join(side("a"), "a").join(side("b"), "b")
        if self.grid is not None:
            small = F.broadcast(self.grid)  # one row per configuration, listed by the caller
            df = df.join(small, "combo_id") if "combo_id" in ids.columns else df.crossJoin(small)
        elif "combo_id" not in ids.columns:
            df = df.withColumn("combo_id", F.lit(0))
        if self.wide:
            # Wide columns are fetched for what the narrow ones leave.
            df = df.filter(self._passes_early).join(heavy("a"), "a").join(heavy("b"), "b")
            for name in ("a", "b"):
                for c in self.wide:
                    df = df.withColumn(f"{name}_", F.col(f"{name}_").withField(c, F.col(f"{name}_{c}")))
        passed = df.filter(self._passes)
        weights = [weight(F.col("a_"), F.col("b_")).alias("weight")] if weight is not None else []
        return passed.select(self.vertex("a").alias("src"), self.vertex("b").alias("dst"), *weights)

    def prepare(self, members: DataFrame, pairs: DataFrame, within: bool = True) -> tuple[DataFrame, DataFrame, bool]:
        """Near cells with their pivots and sizes, the cells of several nodes (none without ``within``), and whether all
        cells are small."""
        cells = members.groupBy("cell").agg(F.min("node_id").alias("pivot"), F.count(F.lit(1)).alias("n"))
        crowded = cells.filter("n > 1") if within else cells.limit(0)
        pairs = materialise(
            pairs.join(cells.select(F.col("cell").alias("u"), F.col("pivot").alias("a"), F.col("n").alias("nu")), "u")
            .join(cells.select(F.col("cell").alias("v"), F.col("pivot").alias("b"), F.col("n").alias("nv")), "v"),
            "pairs",
        )
        # A rotated hash only meets upright ones; nodes that share it need not be alike.
        crowded = crowded.filter("cell.kind <> 'R'")
        tests = pairs.select((F.col("nu") * F.col("nv")).alias("w")).union(
            crowded.select(F.col("n") * (F.col("n") - 1))
        )
        work = tests.agg(F.sum("w").alias("all"), F.max("w").alias("most")).first()
        nodes = self.nodes.count() * self.combos
        return pairs, crowded, (work["all"] or 0) <= REST_PER_NODE * nodes and (work["most"] or 0) <= SMALL_CELL

    @staticmethod
    def every_pair(members: DataFrame, pairs: DataFrame, crowded: DataFrame) -> DataFrame:
        """``(a, b)``: all node pairs of near cells and within cells, for cells that are small."""
        every = pairs.select("u", "v").union(crowded.select(F.col("cell").alias("u"), F.col("cell").alias("v")))
        lhs = every.join(members.select(F.col("cell").alias("u"), F.col("node_id").alias("a")), "u")
        ids = lhs.join(members.select(F.col("cell").alias("v"), F.col("node_id").alias("b")), "v")
        return ids.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def link(self, members: DataFrame, pairs: DataFrame, comps: DataFrame | None = None, within: bool = True) -> DataFrame:
        """Edges between vertices, given ``members(cell, node_id)`` and near cells ``pairs(u, v)``.

        With the components ``comps`` found before, in which the pairs within cells are settled, only what ``pairs`` adds.
        Without ``within``, nodes of one cell are taken never to pass.
        """
        pairs, crowded, small = self.prepare(members, pairs, within and comps is None)
        if small:
            # Testing all members is linear work then, and little per cell.
            return self.test(self.every_pair(members, pairs, crowded))
        return self.link_crowded(members, pairs, crowded, comps)

    def link_crowded(self, members: DataFrame, pairs: DataFrame, crowded: DataFrame,
                     comps: DataFrame | None = None) -> DataFrame:
        """The edges by way of pivots, from what :meth:`prepare` found."""
        n_nodes = self.nodes.count() * self.combos
        stars = members.join(crowded, "cell").select(F.col("pivot").alias("a"), F.col("node_id").alias("b"))
        edges = materialise(self.test(stars.union(pairs.select("a", "b")).distinct()), "links")

        # What is left: cells with more than two members, and pairs of cells that are not one against one.
        open_pairs = pairs.filter("nu > 1 or nv > 1").select("u", "v").union(
            crowded.filter("n > 2").select(F.col("cell").alias("u"), F.col("cell").alias("v"))
        )
        open_pairs = materialise(open_pairs, "open")
        if open_pairs.isEmpty():
            return edges
        touched = open_pairs.select(F.col("u").alias("cell")).union(open_pairs.select("v")).distinct()
        members = members.join(touched, "cell", "left_semi")

        before, fresh = None, edges
        for step in range(PIVOT_ROUNDS + 1):
            # Only what the last round found is solved, on the components of the rounds before.
            comps = materialise(connected_components(fresh), "components") if comps is None else extend_components(comps, fresh)
            state = self._state(members, comps)
            rest = self._rest(open_pairs, state)
            left = rest.agg(F.sum("pairs")).first()[0]
            if not left:
                return edges
            stuck = before is not None and left > 0.8 * before
            if left <= REST_PER_NODE * n_nodes or stuck or step == PIVOT_ROUNDS:
                return edges.union(self.test(self._rest_ids(rest, state)))
            before = left
            # More pivots for each cell, drawn from outside its dominating component, against all its members.
            draws = [
                F.min(F.struct(F.xxhash64("node_id", F.lit(step * NEW_PIVOTS + k)).alias("h"), "node_id"))["node_id"]
                for k in range(NEW_PIVOTS)
            ]
            again = state.filter("not dominant").groupBy("combo_id", "cell").agg(
                F.array_distinct(F.array(*draws)).alias("pivots")
            )
            ids = state.join(again, ["combo_id", "cell"]).select(
                F.explode("pivots").alias("a"), F.col("node_id").alias("b"), "combo_id"
            )
            fresh = materialise(self.test(ids.distinct()), "links")
            edges = edges.union(fresh)

    def _state(self, members: DataFrame, comps: DataFrame) -> DataFrame:
        """Members with their component so far and whether it dominates their cell."""
        if self.grid is not None:
            members = members.crossJoin(F.broadcast(self.grid.select("combo_id")))
        else:
            members = members.withColumn("combo_id", F.lit(0))
        known = members.withColumn("node", self.vertex("node_id")).join(comps, "node", "left")
        known = known.withColumn("component", F.coalesce("component", "node"))
        sizes = known.groupBy("combo_id", "cell", "component").agg(F.count(F.lit(1)).alias("k"))
        tops = sizes.groupBy("combo_id", "cell").agg(
            F.max(F.struct("k", "component")).alias("top"), F.sum("k").alias("total")
        )
        state = known.join(tops, ["combo_id", "cell"])
        return materialise(
            state.select(
                "combo_id", "cell", "node_id", "component", "total", F.col("top.k").alias("k"),
                F.col("top.component").alias("top"), (F.col("component") == F.col("top.component")).alias("dominant"),
            ),
            "state",
        )

    def _rest(self, open_pairs: DataFrame, state: DataFrame) -> DataFrame:
        """Per pair of cells and side flags, how many node pairs are not settled yet."""
        tops = state.groupBy("combo_id", "cell").agg(
            F.first("top").alias("top"), F.first("k").alias("k"), F.first("total").alias("total")
        )
        pick = lambda s: tops.select(
            "combo_id", F.col("cell").alias(s), F.col("top").alias(f"top_{s}"),
            F.col("k").alias(f"k_{s}"), (F.col("total") - F.col("k")).alias(f"o_{s}"),
        )
        df = open_pairs.join(pick("u"), "u").join(pick("v"), ["combo_id", "v"])
        options = [
            F.struct(F.lit(du).alias("du"), F.lit(dv).alias("dv"),
                     (F.col("k_u" if du else "o_u") * F.col("k_v" if dv else "o_v")).alias("pairs"))
            for du, dv in ((False, False), (False, True), (True, False), (True, True))
        ]
        df = df.withColumn("t", F.explode(F.array(*options)))
        df = df.filter("t.pairs > 0").filter(~(F.col("t.du") & F.col("t.dv") & (F.col("top_u") == F.col("top_v"))))
        # Inside one cell the two mixed cases are the same pairs.
        df = df.filter(~((F.col("u") == F.col("v")) & F.col("t.du") & ~F.col("t.dv")))
        return df.select("combo_id", "u", "v", "t.du", "t.dv", "t.pairs")

    def _rest_ids(self, rest: DataFrame, state: DataFrame) -> DataFrame:
        """The node pairs behind :meth:`_rest`, narrowed by dHash keys where the rule demands a near dHash."""
        extra = ["node_id", "dhash", "hist_entropy"] if self.dhash_radius is not None else ["node_id"]
        state = state.join(self.nodes.select(*extra), "node_id")
        side = lambda s, f: state.select(
            "combo_id", F.col("cell").alias(s), F.col("dominant").alias(f), F.col("node_id").alias("n" + s),
            F.col("component").alias("c" + s), *[F.col(c).alias(c + s) for c in extra[1:]],
        )
        mu, mv = side("u", "du"), side("v", "dv")
        if self.dhash_radius is None:
            return self._meet(rest, mu, mv, None)
        upright = (F.col("u.kind") == "U") & (F.col("u.cls") == F.col("v.cls"))
        same_hash = F.col("u.hash") == F.col("v.hash")
        keyed = lambda df, s, r: df.withColumn("sub", F.explode(mask_keys(F.col("dhash" + s), r)))
        low = lambda s: F.coalesce(F.col("hist_entropy" + s) < self.low_entropy, F.lit(False))
        parts = [self._meet(rest.filter(~upright), mu, mv, None)]
        parts.append(self._meet(rest.filter(upright & ~same_hash), keyed(mu, "u", self.dhash_radius),
                                keyed(mv, "v", self.dhash_radius), "sub"))
        equal = rest.filter(upright & same_hash)
        parts.append(self._meet(equal, keyed(mu.filter(low("u")), "u", self.low_radius),
                                keyed(mv.filter(low("v")), "v", self.low_radius), "sub"))
        parts.append(self._meet(equal, mu.filter(~low("u")), mv, None))
        parts.append(self._meet(equal, mu.filter(low("u")), mv.filter(~low("v")), None))
        out = parts[0]
        for part in parts[1:]:
            out = out.union(part)
        return out.distinct()

    def _meet(self, rest: DataFrame, mu: DataFrame, mv: DataFrame, sub: str | None) -> DataFrame:
        """Join both sides of every open pair of cells.

        Without a further key the meetings at a busy right side are cut into a square of blocks: each side is
        split one way and copied the other, so copies grow with the root of the number of tasks.
        """
        key = ["combo_id", "v", "dv"]
        if sub:
            met = rest.join(mu, ["combo_id", "u", "du"]).join(mv, [*key, sub])
        else:
            side = F.ceil(F.sqrt(F.sum("pairs") / TASK_PAIRS))
            busy = rest.groupBy(*key).agg(F.greatest(F.lit(1), side).cast("int").alias("side"))
            block = lambda node: F.pmod(F.xxhash64(node), F.col("side")).cast("int")
            every = F.explode(F.sequence(F.lit(0), F.col("side") - 1))
            lhs = rest.join(busy, key).join(mu, ["combo_id", "u", "du"])
            lhs = lhs.withColumn("row_block", block("nu")).withColumn("column_block", every)
            rhs = mv.join(busy, key).withColumn("column_block", block("nv")).withColumn("row_block", every)
            met = lhs.join(rhs.drop("side"), [*key, "row_block", "column_block"])
        return met.filter("cu <> cv").select(F.col("nu").alias("a"), F.col("nv").alias("b"), "combo_id")
