"""Bayesian networks over the columns: structure search, local networks and smoothed conditional probabilities."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellmend.operators.stats import domain_sizes
from cellmend.operators.structure import reaches
from cellmend.sources.scratch import Scratch

Edge = tuple[str, str]
#: Equivalent sample sizes of the structure score and of the probabilities.
SCORE_SIZE, CPD_SIZE = 50.0, 5.0
#: Families that one job counts.
TOGETHER = 64


@dataclass(frozen=True)
class Local:
    """A column with its parents and children."""

    node: str
    parents: tuple[str, ...]
    children: tuple[str, ...]


def local_networks(nodes: list[str], edges: list[Edge]) -> dict[str, Local]:
    return {n: Local(n, tuple(a for a, b in edges if b == n), tuple(b for a, b in edges if a == n)) for n in nodes}


def filter_weak(networks: dict[str, Local], mu_plus: dict[Edge, float], gamma: float = 0.25) -> dict[str, Local]:
    """Without columns whose only neighbour determines them by less than ``gamma``."""

    def strong(local: Local) -> bool:
        near = local.parents + local.children
        return len(near) != 1 or mu_plus.get((near[0], local.node), 0.0) >= gamma

    return {n: x for n, x in networks.items() if strong(x)}


def lgamma(x: Column) -> Column:
    """The log of the gamma function of positive numbers, which Spark lacks: Stirling's series at x + 8, and eight steps back."""
    z = x + 8
    steps = x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6) * (x + 7)
    series = 1 / (12 * z) - 1 / (360 * F.pow(z, F.lit(3.0))) + 1 / (1260 * F.pow(z, F.lit(5.0))) - 1 / (1680 * F.pow(z, F.lit(7.0)))
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - F.log(steps)


def family_counts(df: DataFrame, child: str, parents: list[str]) -> DataFrame:
    """``(parents..., child, n, nu)``: rows with each state, and with its parents' state."""
    n = df.groupBy(*parents, child).agg(F.count("*").alias("n"))
    if not parents:
        return n.join(F.broadcast(n.agg(F.sum("n").alias("nu"))))  # one row
    return n.join(n.groupBy(*parents).agg(F.sum("n").alias("nu")), parents)


def cardinalities(df: DataFrame, columns: list[str]) -> dict[str, int]:
    return {c: int(n) for c, n in domain_sizes(df, columns).first().asDict().items()}


def _scores_of(counted: DataFrame, families: list[tuple[str, list[str]]], card: dict[str, int], size: float) -> DataFrame:
    """``(place, score)`` from ``(place, u, x, n)``: rows with each state of the parents (an array) and of the column."""
    q = [math.prod(card[p] for p in parents) for _, parents in families]
    of_parents, of_states = ([size / n for n in q], [size / (n * card[c]) for n, (c, _) in zip(q, families)])

    def terms(counts: DataFrame, alphas: list[float], sign: int) -> DataFrame:
        alpha = F.get(F.lit(alphas), F.col("place"))
        return counts.groupBy("place").agg((sign * F.sum(lgamma(F.col("n") + alpha) - lgamma(alpha))).alias("score"))

    both = terms(counted, of_states, 1).unionByName(terms(counted.groupBy("place", "u").agg(F.sum("n").alias("n")), of_parents, -1))
    return both.groupBy("place").agg(F.sum("score").alias("score"))


def _family(i: int, child: str, parents: list[str], value: Callable[[str], Column] = F.col) -> Column:
    return F.struct(F.lit(i).alias("place"), F.array(*[value(p) for p in parents], F.lit("")).alias("u"), value(child).alias("x"))


def family_scores(df: DataFrame, families: list[tuple[str, list[str]]], card: dict[str, int], size: float = SCORE_SIZE) -> DataFrame:
    """``(place, score)``: the BDeu score of each column given its parents, by place in the list; configurations that never occur add
    nothing. All families are counted in one pass over the rows."""
    rows = df.select(F.inline(F.array(*[_family(i, c, parents) for i, (c, parents) in enumerate(families)])))
    return _scores_of(rows.groupBy("place", "u", "x").agg(F.count("*").alias("n")), families, card, size)


def family_score(df: DataFrame, child: str, parents: list[str], card: dict[str, int], size: float = SCORE_SIZE) -> DataFrame:
    """``(score)``: the BDeu score of one column given its parents."""
    return family_scores(df, [(child, parents)], card, size).select("score")


class ContingencyTree:
    """Counts of the rows by the values of sets of columns, each made from the smallest stored set that holds it.

    The root counts the rows by all columns, in one pass over them; it has as many rows as there are different ones. Other sets are
    marginals of sets stored before, so the rows are read once, whatever is asked; the sets of one request that have one origin are counted
    in one pass over it and stored together. The driver holds each set's number of counts.
    """

    def __init__(self, df: DataFrame, columns: list[str], scratch: Scratch | None = None):
        self.columns, self.scratch = list(columns), scratch or Scratch(df.sparkSession)
        root = self.scratch.put("root", df.groupBy(*columns).agg(F.count("*").alias("n")))
        self.root = root.select(F.lit(0).alias("node"), F.array(*columns).alias("vals"), "n")
        #: By set: its columns in order, the table that holds it, its number in the table, and its counts.
        self.nodes: dict[frozenset[str], tuple[list[str], DataFrame, int, int]] = {frozenset(columns): (self.columns, self.root, 0, root.count())}

    def origin(self, wanted: frozenset[str]) -> frozenset[str]:
        """The stored set of the fewest counts that holds the wanted one."""
        return min((s for s in self.nodes if wanted <= s), key=lambda s: (self.nodes[s][3], len(s), sorted(s)))

    def ensure(self, sets: list[frozenset[str]]) -> None:
        """Store the sets that are not stored yet."""
        new = sorted({*sets} - {*self.nodes}, key=sorted)
        made, numbers = [], {s: i for i, s in enumerate(new)}
        origins: dict[frozenset[str], list[frozenset[str]]] = {}
        for s in new:
            origins.setdefault(self.origin(s), []).append(s)
        for o, group in origins.items():
            columns, table, node, _ = self.nodes[o]
            cells = [F.struct(F.lit(numbers[s]).alias("node"), F.array(*[F.get("vals", F.lit(columns.index(c))) for c in sorted(s)]).alias("vals")) for s in group]
            made.append(table.where(F.col("node") == node).select(F.inline(F.array(*cells)), "n").groupBy("node", "vals").agg(F.sum("n").alias("n")))
        if made:
            table = self.scratch.put("counts", reduce(DataFrame.unionByName, made))
            sizes = {r["node"]: r["counts"] for r in table.groupBy("node").agg(F.count("*").alias("counts")).collect()}  # a row for each set
            for s in new:
                self.nodes[s] = (sorted(s), table, numbers[s], sizes.get(numbers[s], 0))

    def scores(self, families: list[tuple[str, list[str]]], card: dict[str, int], size: float = SCORE_SIZE) -> list[float]:
        """The families' BDeu scores, as of ``family_scores``."""
        self.ensure([frozenset([c, *parents]) for c, parents in families])
        tables: dict[int, list[int]] = {}
        for i, (c, parents) in enumerate(families):
            tables.setdefault(id(self.nodes[frozenset([c, *parents])][1]), []).append(i)
        counted = None
        for places in tables.values():
            of = [(i, families[i], self.nodes[frozenset([families[i][0], *families[i][1]])]) for i in places]
            at = lambda columns: lambda name: F.get("vals", F.lit(columns.index(name)))
            by = F.create_map(*[x for node in sorted({n[2] for _, _, n in of}) for x in (F.lit(node), F.array(*[_family(i, c, parents, at(n[0])) for i, (c, parents), n in of if n[2] == node]))])
            rows = of[0][2][1].where(F.col("node").isin([n[2] for _, _, n in of])).select(F.inline(by[F.col("node")]), "n")
            counted = rows if counted is None else counted.unionByName(rows)
        found = {r["place"]: r["score"] for r in _scores_of(counted, families, card, size).collect()}  # a row for each family
        return [found.get(i, 0.0) for i in range(len(families))]


def hill_climb(df: DataFrame, columns: list[str], fixed: list[Edge] = (), size: float = SCORE_SIZE, epsilon: float = 1e-4, rounds: int = 1000, tabu: int = 100, patience: int = 0, trace: list[tuple[Edge, str, float]] | None = None) -> list[Edge]:
    """Search by adding, removing and turning edges; fixed edges stay. The best structure that was met.

    Each round makes the move of the highest gain that does not undo one of the last ``tabu`` moves. A move that gains less than
    ``epsilon`` over the best structure so far is made only while fewer than ``patience`` such moves came one after another (none: the search
    ends where no move gains). Equal moves go by column order. Families are counted by Spark in a ``ContingencyTree``, which reads the rows
    once, and scored once; the driver holds one number for each. ``trace`` receives each move's edge, kind and score so far.
    """
    scratch = Scratch(df.sparkSession)
    tree, card, memo = ContingencyTree(df, columns, scratch), cardinalities(df, columns), {}
    edges = list(dict.fromkeys(fixed))

    def learn(families: set[tuple[str, frozenset[str]]]) -> None:
        new = sorted((c, sorted(ps)) for c, ps in families if (c, ps) not in memo)
        for start in range(0, len(new), TOGETHER):
            part = new[start : start + TOGETHER]
            for (c, ps), score in zip(part, tree.scores(part, card, size)):
                memo[c, frozenset(ps)] = score

    def of(child: str) -> frozenset[str]:
        return frozenset(a for a, b in edges if b == child)

    def moves() -> Iterator[tuple[float, str, Edge]]:
        for a in columns:
            for b in columns:
                if a == b:
                    continue
                if (a, b) not in edges and (b, a) not in edges:
                    if not reaches(edges, b, a):
                        yield memo[b, of(b) | {a}] - memo[b, of(b)], "add", (a, b)
                elif (a, b) in edges and (a, b) not in fixed:
                    gain = memo[b, of(b) - {a}] - memo[b, of(b)]
                    yield gain, "remove", (a, b)
                    if not reaches([e for e in edges if e != (a, b)], a, b):
                        yield gain + memo[a, of(a) | {b}] - memo[a, of(a)], "turn", (a, b)

    undo = {"add": lambda e: ("remove", e), "remove": lambda e: ("add", e), "turn": lambda e: ("turn", e[::-1])}
    barred: deque[tuple[str, Edge]] = deque(maxlen=tabu)
    now = top = 0.0
    best, idle = list(edges), 0
    for _ in range(rounds):
        learn({(b, ps) for a in columns for b in columns if a != b for ps in (of(b), of(b) | {a}, of(b) - {a})})
        chosen = None
        for gain, kind, edge in moves():
            if (kind, edge) not in barred and (chosen is None or gain > chosen[0]):
                chosen = (gain, kind, edge)
        if chosen is None or (now + chosen[0] <= top + epsilon and idle >= patience):
            break
        gain, kind, (a, b) = chosen
        now += gain
        barred.append(undo[kind]((a, b)))
        edges = [*edges, (a, b)] if kind == "add" else [e for e in edges if e != (a, b)] + ([(b, a)] if kind == "turn" else [])
        idle = 0 if now > top + epsilon else idle + 1
        if now > top + epsilon:
            top, best = now, list(edges)
        if trace is not None:
            trace.append(((a, b), kind, now))
    scratch.clear()
    return best


def conditional(df: DataFrame, child: str, parents: list[str], card: dict[str, int], size: float = CPD_SIZE) -> DataFrame:
    """``(parents..., child, p)`` of the states that occur: (n + a/(q r)) / (nu + a/q)."""
    q, r = math.prod(card[p] for p in parents), card[child]
    return family_counts(df, child, parents).select(*parents, child, ((F.col("n") + size / (q * r)) / (F.col("nu") + size / q)).alias("p"))
