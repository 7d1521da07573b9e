"""The alias dictionary: canonical names, variants, countries, a tree of depth one, patterns."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from benefactor.data.funders import FUNDERS

_BOUND = r"[\p{L}\p{N}_]"


def is_acronym(variant: str) -> bool:
    """Short and all upper case: such a variant matches as a whole word only."""
    return len(variant) <= 6 and variant.isupper()


@dataclass
class AliasDictionary:
    """Canonicals in order of first appearance. A canonical name is always a variant of its own."""

    variants: dict[str, list[str]] = field(default_factory=dict)
    country: dict[str, str] = field(default_factory=dict)
    parent: dict[str, str] = field(default_factory=dict)
    by_variant: dict[str, str] = field(default_factory=dict)

    @classmethod
    def from_rows(cls, rows: Iterable[tuple[str, str, str | None, str | None]]) -> AliasDictionary:
        """Rows of canonical, variant, country, parent; of equal variants the last row wins."""
        made = cls()
        for canonical, variant, country, parent in rows:
            known = made.variants.setdefault(canonical, [])
            for name in (variant, canonical):
                made.by_variant[name.lower()] = canonical
                if name not in known:
                    known.append(name)
            if country is not None:
                made.country[canonical] = country
            if parent is not None:
                made.parent[canonical] = parent
        chained = sorted(c for c, p in made.parent.items() if p in made.parent)
        if chained:
            raise ValueError(f"parents must not have parents: {chained}")
        return made

    @classmethod
    def shipped(cls) -> AliasDictionary:
        return cls.from_rows((name, v, country, parent) for name, country, parent, more in FUNDERS for v in (*more, name))

    @classmethod
    def from_frame(cls, aliases: DataFrame) -> AliasDictionary:
        """From an alias table (about a hundred rows) with optional country and parent_funder."""
        have = set(aliases.columns)
        columns = ["canonical_name", "variant"] + [c for c in ("country", "parent_funder") if c in have]
        rows = [r.asDict() for r in aliases.select(*columns).collect()]
        return cls.from_rows((r["canonical_name"], r["variant"], r.get("country"), r.get("parent_funder")) for r in rows)

    def names(self) -> list[str]:
        return list(self.variants)

    def canonical(self, name: str) -> str:
        return self.by_variant.get(name.lower(), name)

    def variants_of(self, canonical: str) -> set[str]:
        return set(self.variants.get(canonical, (canonical,)))

    def children_of(self, parent: str) -> list[str]:
        return [c for c, p in self.parent.items() if p == parent]

    def pattern(self, canonical: str) -> str:
        """All variants as one regular expression, to be matched without regard to case."""
        ordered = sorted(self.variants[canonical], key=len, reverse=True)
        return "|".join(rf"(?<!{_BOUND}){re.escape(v)}(?!{_BOUND})" if is_acronym(v) else re.escape(v) for v in ordered)

    def frame(self, spark: SparkSession) -> DataFrame:
        """position, canonical_name, country, parent_funder, n_variants: one row a canonical."""
        rows = [(i, c, self.country.get(c), self.parent.get(c), len(v)) for i, (c, v) in enumerate(self.variants.items())]
        return spark.createDataFrame(rows, "position int, canonical_name string, country string, parent_funder string, n_variants int")

    def variant_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(c, v) for c, known in self.variants.items() for v in known]
        return spark.createDataFrame(rows, "canonical_name string, variant string")

    def lookup_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.by_variant.items()), "variant_key string, canonical_name string")
