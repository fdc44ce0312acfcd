"""Designs of regressions from named groups of features, and fits of chosen combinations of groups."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.statistics import irls, standardize


@dataclass(frozen=True)
class Group:
    """Features of one kind: names and what they are. A null of an `optional` group is 0, else it takes the row out."""

    features: dict[str, Column]
    optional: bool = False


def one_hot(column: str, contains: dict[str, str]) -> Group:
    """1 for the first of the texts that a value contains, in the order given; a null or another value has none."""
    seen, out = F.lit(False), {}
    for name, text in contains.items():
        here = F.coalesce(F.contains(F.col(column), F.lit(text)), F.lit(False))
        out[name] = F.when(here & ~seen, 1.0).otherwise(0.0)
        seen = seen | here
    return Group(out, optional=True)


def _fit(name: str, terms: list[str], y: str, period: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.ones((len(pdf), len(terms)))
        if terms[1:]:
            m[:, 1:] = standardize(pdf[terms[1:]].to_numpy(float))
        b = irls(m, pdf[y].to_numpy(float))
        if b is None:
            return pd.DataFrame(columns=["combination", "period", "term", "beta", "n"])
        return pd.DataFrame({"combination": name, "period": pdf[period].iloc[0], "term": terms, "beta": b, "n": len(pdf)})

    return run


@dataclass(frozen=True)
class Design:
    """Named groups over a frame's columns."""

    groups: dict[str, Group] = field(default_factory=dict)

    def names(self, chosen: list[str]) -> list[str]:
        """Terms of a combination of groups, the intercept first."""
        return ["intercept", *(f for g in chosen for f in self.groups[g].features)]

    def rows(self, df: DataFrame, chosen: list[str], keep: list[str]) -> DataFrame:
        """df's columns `keep` and the chosen groups' features as doubles; rows that lack one that is needed are left out."""
        if len(set(names := self.names(chosen))) < len(names) or set(names) & set(keep):
            raise ValueError(f"features share names: {names} beside {keep}")
        made, need = [], F.lit(True)
        for g in chosen:
            for name, c in self.groups[g].features.items():
                c = c.cast("double")
                made.append((F.coalesce(F.when(~F.isnan(c), c), F.lit(0.0)) if self.groups[g].optional else c).alias(name))
                if not self.groups[g].optional:
                    need = need & F.col(name).isNotNull() & ~F.isnan(name)
        return df.select(*keep, *made).where(need)

    def fits(self, df: DataFrame, combinations: dict[str, list[str]], y: str, period: str) -> DataFrame:
        """(combination, period, term, beta, n) of a logistic regression of each combination of groups in each period, features
        standardised within it; a period without both outcomes, five rows or a solution has no row. A period is one task's
        rows: days, not histories (`statistics.expanding_logit` fits those)."""
        out = None
        for name, chosen in combinations.items():
            terms = self.names(chosen)
            x = self.rows(df, chosen, [period, y]).where(F.col(y).isNotNull())

            kind = df.schema[period].dataType.simpleString()
            part = x.groupBy(period).applyInPandas(_fit(name, terms, y, period), f"combination string, period {kind}, term string, beta double, n long")
            out = part if out is None else out.unionByName(part)
        if out is None:
            raise ValueError("no combination of groups is given")
        return out
