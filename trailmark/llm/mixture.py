"""Mixing sources to target weights: hierarchical budgets over a tree, seeded epochs, token prefixes.

The tree has three levels: domain, language, source. A node's budget is shared among its children by
weight. A child that has fewer tokens than its share, over all epochs it may be read, takes what
it has, and its shortage goes to its siblings by weight; only what no sibling can take rises
to the parent's siblings. A leaf of ``a`` tokens and budget ``b`` is read ``b // a`` times as
a whole; for the rest its rows are put in the order of a hash of seed, epoch and row, and the
shortest prefix that reaches the rest is taken.

The prefix ends at a cut value of that hash. It is found exactly by two rounds of token sums over ``BINS``
bins and one over the few distinct values left, each for all leaves at once; then one
filter over the table selects the rows. No leaf is ever sorted or gathered, however hot. Leaves
are as many as the tree names: what it does not name is one leaf "other" of its parent.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.llm.shared import materialise

OTHER = "other"
BINS = 4096


@dataclass(frozen=True)
class Mix:
    """Target weights. ``domains``: domain -> its sources with their weights; languages may differ by domain."""

    domains: Mapping[str, Mapping[str, float]]
    domain_weights: Mapping[str, float] = field(default_factory=dict)
    languages: Mapping[str, float] = field(default_factory=dict)
    seed: int = 20
    epochs: int = 2  # most readings of a leaf
    budget: float = 1.0  # tokens, as a share of those there are

    def domain_of(self) -> dict[str, str]:
        return {source: domain for domain, sources in self.domains.items() for source in sources}

    def weight(self, path: tuple[str, ...]) -> float:
        table = (self.domain_weights, self.languages, self.domains.get(path[0], {}))[len(path) - 1]
        return float(table.get(path[-1], 1.0 if path[-1] != OTHER else min(table.values(), default=1.0)))


def default_mix() -> Mix:
    """Twenty sources in two domains, three languages beside English."""
    halves = {"web": range(10), "library": range(10, 20)}
    return Mix(
        domains={domain: {f"src{i}": 1.0 for i in numbers} for domain, numbers in halves.items()},
        domain_weights={"web": 0.6, "library": 0.4},
        languages={"en": 0.6, "de": 0.15, "fr": 0.15, "es": 0.1},
    )


def share_out(total: int, children: Mapping[str, tuple[float, int]]) -> dict[str, int]:
    """Whole tokens for children of (weight, capacity): by weight, shortages to those with room.

    Ends are rounded by largest remainder, ties by name. Nothing is given above a capacity.
    """
    total = min(total, sum(capacity for _, capacity in children.values()))
    given: dict[str, int] = {}
    open_ = {name: Fraction(weight) for name, (weight, capacity) in children.items()}
    left = total
    while open_:
        weights = sum(open_.values())
        if not weights:  # only children of weight 0 have room
            open_ = {name: Fraction(1) for name in open_}
            weights = sum(open_.values())
        full = [name for name, w in open_.items() if left * w / weights >= children[name][1]]
        if not full:
            exact = {name: left * w / weights for name, w in open_.items()}
            floors = {name: int(x) for name, x in exact.items()}
            rest = left - sum(floors.values())
            for name in sorted(exact, key=lambda n: (floors[n] - exact[n], n))[:rest]:
                floors[name] += 1
            return given | floors
        for name in full:
            given[name] = children[name][1]
            left -= children[name][1]
            del open_[name]
    return given


def budgets(available: Mapping[tuple[str, ...], int], mix: Mix) -> dict[tuple[str, ...], int]:
    """Tokens for each leaf (domain, language, source) from the tokens there are."""
    capacity: dict[tuple[str, ...], int] = {}
    for leaf, tokens in available.items():
        for depth in range(len(leaf) + 1):
            capacity[leaf[:depth]] = capacity.get(leaf[:depth], 0) + tokens * mix.epochs
    found = {(): int(mix.budget * sum(available.values()))}
    for depth in range(3):
        for parent in [p for p in list(found) if len(p) == depth]:
            children = {p[-1]: (mix.weight(p), c) for p, c in capacity.items() if len(p) == depth + 1 and p[:-1] == parent}
            found |= {(*parent, name): tokens for name, tokens in share_out(found[parent], children).items()}
    return {path: tokens for path, tokens in found.items() if len(path) == 3}


def words(text: Column) -> Column:
    """Tokens of a text for the budget: runs without white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+")).cast("bigint")


def _leaf(mix: Mix) -> list[Column]:
    """domain, language, source as the tree names them."""
    domain_of = mix.domain_of()
    sources = F.create_map(*[F.lit(x) for pair in (domain_of or {"": OTHER}).items() for x in pair])
    known = F.array(*[F.lit(x) for x in (mix.languages or {"": 0})])
    domain = F.coalesce(sources[F.coalesce("source", F.lit(""))], F.lit(OTHER))
    source = F.when(domain == OTHER, F.lit(OTHER)).otherwise(F.col("source"))
    language = F.when(F.array_contains(known, F.coalesce("lang", F.lit(""))), F.col("lang")).otherwise(F.lit(OTHER))
    return [domain.alias("domain"), language.alias("language"), source.alias("leaf_source")]


def _row_hash(docs: DataFrame) -> Column:
    """Hash of all columns of a row; equal rows are equal."""
    plain = [f.name for f in docs.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return F.xxhash64(*plain)


def _cuts(rows: DataFrame, rest: dict[str, int]) -> dict[str, tuple[int, int]]:
    """For each leaf the order value at which its prefix ends, and how many equal rows of it belong to it.

    ``rows``: leaf, order (64-bit, uniform), tokens. Three rounds, each collecting one row per leaf.
    """
    spans = {leaf: (0, 0, tokens) for leaf, tokens in rest.items() if tokens > 0}  # level prefix, value, tokens still wanted
    unsigned = F.col("order").bitwiseXOR(F.lit(-(1 << 63)))  # sorts as the signed value does
    for level, bits in ((1, 12), (2, 24)):
        spans = _crossing(rows.withColumn("bin", F.shiftrightunsigned(unsigned, 64 - bits)), spans, bits - 12)
    wanted = _literal({leaf: value for leaf, (_, value, _) in spans.items()})
    last = rows.where(F.shiftrightunsigned(unsigned, 40) == wanted[F.col("leaf")])
    values = last.groupBy("leaf", "order").agg(F.max("tokens").alias("tokens"), F.count("*").alias("n"))
    before = Window.partitionBy("leaf").orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
    values = values.withColumn("before", F.coalesce(F.sum(F.col("tokens") * F.col("n")).over(before), F.lit(0)))
    want = _literal({leaf: tokens for leaf, (_, _, tokens) in spans.items()})[F.col("leaf")]
    end = values.where((F.col("before") < want) & (F.col("before") + F.col("tokens") * F.col("n") >= want))
    end = end.select("leaf", "order", F.ceil((want - F.col("before")) / F.col("tokens")).cast("bigint").alias("copies"))
    return {r.leaf: (r.order, r.copies) for r in end.collect()} if spans else {}


def _literal(values: Mapping[str, object]) -> Column:
    """One entry per leaf."""
    return F.create_map(*[F.lit(x).cast("bigint") if i % 2 else F.lit(x) for pair in (values or {"": 0}).items() for i, x in enumerate(pair)])


def _crossing(rows: DataFrame, spans: dict, parent_bits: int) -> dict:
    """Narrow each leaf to the bin in which its running total reaches what is wanted."""
    if not spans:
        return spans
    want = _literal({leaf: tokens for leaf, (_, _, tokens) in spans.items()})[F.col("leaf")]
    if parent_bits:
        rows = rows.where(F.shiftright("bin", 12) == _literal({leaf: value for leaf, (_, value, _) in spans.items()})[F.col("leaf")])
    sums = rows.groupBy("leaf", "bin").agg(F.sum("tokens").alias("tokens"))  # at most BINS rows per leaf
    before = Window.partitionBy("leaf").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    hit = sums.where((F.col("before") < want) & (F.col("before") + F.col("tokens") >= want))
    return {r.leaf: (parent_bits, r.bin, spans[r.leaf][2] - r.before) for r in hit.select("leaf", "bin", "before").collect()}


def mixed(docs: DataFrame, mix: Mix | None = None, more: bool = False) -> DataFrame:
    """The rows of ``docs`` (columns text, lang, source among others), each as often as it is read.

    With ``more``, columns domain, language, leaf_source, epoch and n_tokens follow. Null or unnamed languages and
    sources belong to leaves "other". Texts without tokens are read in whole epochs, or if their place in the order lies before
    the cut. Equal rows are one value in the order; if the cut falls among them, just as many of them are taken as the
    budget needs. An empty table gives no row.
    """
    mix = mix or default_mix()
    domain, language, source = _leaf(mix)
    marked = docs.select(
        F.struct("*").alias("row"), domain, language, source, _row_hash(docs).alias("hash"), words(F.col("text")).alias("tokens")
    ).withColumn("leaf", F.concat_ws("\x1f", "domain", "language", "leaf_source"))
    narrow = materialise(marked.select("leaf", "hash", "tokens"), "mix_rows")

    available = {tuple(r.leaf.split("\x1f")): r.tokens for r in narrow.groupBy("leaf").agg(F.sum("tokens").alias("tokens")).collect()}
    wanted = {"\x1f".join(path): (tokens, available[path]) for path, tokens in budgets(available, mix).items()}
    whole = {leaf: (b // a if a else 0) for leaf, (b, a) in wanted.items()}
    rest = {leaf: b - whole[leaf] * a for leaf, (b, a) in wanted.items()}
    order = F.xxhash64(F.lit(mix.seed), _literal(whole)[F.col("leaf")], "hash").alias("order")
    cuts = _cuts(narrow.select("leaf", order, "tokens"), rest)

    cut = _literal({leaf: cuts[leaf][0] if leaf in cuts else -(1 << 63) for leaf in wanted})[F.col("leaf")]
    placed = marked.select("*", order, _literal(whole)[F.col("leaf")].cast("int").alias("whole"))
    epochs = F.sequence(F.lit(0), F.lit(max(whole.values(), default=0)))
    read = F.filter(epochs, lambda e: (e < F.col("whole")) | (e == F.col("whole")) & (F.col("order") < cut))
    found = placed.select("row", "domain", "language", "leaf_source", F.explode(read).alias("epoch"), "tokens")
    # Rows at the cut itself: equal ones are first gathered into one, then repeated as often as the budget needs.
    at_cut = placed.where(F.col("leaf").isin(list(cuts)) & (F.col("order") == cut)) if cuts else placed.limit(0)
    at_cut = at_cut.groupBy("leaf", "order").agg(F.first(F.struct("row", "domain", "language", "leaf_source", "whole", "tokens")).alias("one"))
    copies = _literal({leaf: n for leaf, (_, n) in cuts.items()})[F.col("leaf")].cast("int")
    last = at_cut.select("one.*", F.explode(F.array_repeat(F.col("one.whole"), copies)).alias("epoch"))
    found = found.unionByName(last.select(found.columns))
    extra = ["domain", "language", "leaf_source", "epoch", F.col("tokens").alias("n_tokens")]
    return found.select("row.*", *(extra if more else []))
