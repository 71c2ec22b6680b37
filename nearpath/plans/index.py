"""The two search structures as whole plans: draw a family over both sides, sign, search, verify."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearpath.config import LshConfig, TableConfig, TrieConfig
from nearpath.functions.lsh import Family
from nearpath.operators import collide, hamming, preprocess, verify
from nearpath.operators.copies import both, expand
from nearpath.sources.store import cut


def family_for(config: LshConfig, *curves: DataFrame, perturbed: bool = False) -> Family:
    """The family of a seed; with curves, one with enough coefficients for the longest of them, as the
    column expressions need (``sign`` draws more by itself)."""
    longest = max(preprocess.max_points(c) for c in curves) if curves else 0
    return Family.draw(config, max(64, longest), perturbed)


@dataclass
class TableIndex:
    """Collision search with optional partial verification."""

    data: DataFrame
    lsh: LshConfig
    config: TableConfig = TableConfig()
    perturbed: bool = False

    def query(self, queries: DataFrame) -> DataFrame:
        family = family_for(self.lsh, perturbed=self.perturbed)
        asked, data = both(queries, self.data, "pts")
        signed = collide.signed_classes(data, family)
        kept = ("copies", "few", "pts") if self.config.verifies else ("few",)
        found = collide.class_scores(signed if asked is data else collide.signed_classes(asked, family), signed, kept=kept)
        if not self.config.verifies:
            return expand(found.drop("score"), asked, data)
        return verify.class_by_score(found, asked, data, self.config.verify_fraction, self.config.distance).select("query", "candidate")


@dataclass
class TrieIndex:
    """Hamming range search over sketches; with a distance, pairs in doubt are verified."""

    data: DataFrame
    lsh: LshConfig
    config: TrieConfig = TrieConfig()

    def query(self, queries: DataFrame) -> DataFrame:
        self.config.check(self.lsh)
        family = family_for(self.lsh)
        coded = lambda c: collide.signatures(c, family).withColumnRenamed("hashes", "code")
        codes = cut(coded(self.data), "codes")  # read more than once
        asked = codes if queries is self.data else cut(coded(queries), "codes")
        if self.config.distance is None:
            return hamming.prefix_search(asked, codes, self.config).select("query", "candidate")
        # candidates are what the tree yields; the early-exit count alone judges them
        radius = self.config.radius
        met = hamming.early_exit_search(asked, codes, radius, verify.sure_up_to(radius))
        found = hamming.on_leaf(met, hamming.leaf_depths(codes, self.config), self.config.errors)
        return verify.by_sketch(found, queries, self.data, radius, self.config.distance).select("query", "candidate")
