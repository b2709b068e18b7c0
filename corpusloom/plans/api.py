"""A corpus as a queryable object: typed lookups and read-only SQL over named views."""

from __future__ import annotations

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import model, pairs, stats


class Corpus:
    """Lookups over tokens (unit_id, grp, tok_no, surface, key, subkey), units
    (unit_id, grp, text) and, where there are any, segments (unit_id, tok_no,
    seg_no, ...).  ``bags`` may give the keys of each unit in one row (items)."""

    def __init__(self, spark: SparkSession, tokens: DataFrame, units: DataFrame, segments: DataFrame | None = None, bags: DataFrame | None = None):
        self.spark, self.tokens, self.units, self.segments, self.bags = spark, tokens, units, segments, bags

    def groups(self) -> DataFrame:
        """(grp, units, tokens) of every group, in order."""
        t = self.tokens.groupBy("grp").agg(F.count(F.lit(1)).alias("tokens"))
        u = self.units.groupBy("grp").agg(F.count(F.lit(1)).alias("units"))
        return u.join(t, "grp", "left").select("grp", "units", F.coalesce("tokens", F.lit(0)).alias("tokens")).orderBy("grp")

    def group(self, grp) -> DataFrame:
        return self.groups().filter(F.col("grp") == grp)

    def units_of(self, grp) -> DataFrame:
        return model.lookup(self.units, ["unit_id"], grp=grp)

    def unit(self, unit_id) -> DataFrame:
        return model.lookup(self.units, ["unit_id"], unit_id=unit_id)

    def unit_with_tokens(self, unit_id) -> DataFrame:
        """The unit's row beside each of its tokens, in order; a unit without tokens is one row."""
        own = self.tokens.filter(F.col("unit_id") == unit_id).drop("grp")
        return self.unit(unit_id).join(own, "unit_id", "left").orderBy("tok_no")

    def token(self, unit_id, tok_no) -> DataFrame:
        """One token beside its segments, in order."""
        own = self.tokens.filter((F.col("unit_id") == unit_id) & (F.col("tok_no") == tok_no))
        if self.segments is None:
            return own
        return own.join(self.segments, ["unit_id", "tok_no"], "left").orderBy("seg_no")

    def key_with_subkeys(self, key: str) -> DataFrame:
        """(key, subkey, n) by falling count."""
        t = self.tokens.filter((F.col("key") == key) & F.col("subkey").isNotNull())
        return t.groupBy("key", "subkey").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "subkey")

    def tokens_of(self, unit_id) -> DataFrame:
        return model.lookup(self.tokens, ["tok_no"], unit_id=unit_id)

    def find(self, text: str, limit: int = 50, how: str = "exact") -> DataFrame:
        return model.search(self.tokens, "surface", text, ["unit_id", "tok_no"], limit, how)

    def key_map(self, key: str, limit: int | None = None) -> DataFrame:
        return model.key_map(self.tokens, key, ["unit_id", "tok_no"], limit)

    def top_keys(self, n: int = 20) -> DataFrame:
        return model.top_rows(stats.key_frequency(self.tokens), [F.desc("occurrences"), "key"], n)

    def cooccurring(self, key: str, floor: int = 2, limit: int = 30) -> DataFrame:
        if self.bags is not None:
            return pairs.partners_in_rows(self.bags, key, floor, limit)
        return pairs.partners(self.tokens, key, floor, limit)

    def totals(self) -> DataFrame:
        return stats.corpus_totals(self.tokens, self.units)

    def views(self) -> dict[str, DataFrame]:
        t = self.tokens
        return {
            "v_token": t, "v_unit": self.units, "v_key_freq": stats.key_frequency(t), "v_subkey_freq": stats.frequency(t, "subkey"),
            "v_group_stats": stats.group_profile(self.units.select("grp").distinct(), t, self.units),
        }

    def sql(self, text: str, args: dict | None = None) -> DataFrame:
        """One query with named parameters; views are passed by name, so nothing
        is registered.  A statement that is not a query is refused: as a
        subquery it does not parse."""
        names = {k: v for k, v in self.views().items() if "{" + k + "}" in text}
        body = text.strip().rstrip(";")
        try:
            self.spark.sql(f"SELECT * FROM (\n{body}\n) WHERE false", args=args or {}, **names)
        except ParseException as e:
            raise ValueError("only a single query is allowed") from e
        return self.spark.sql(text, args=args or {}, **{k: v for k, v in self.views().items() if "{" + k + "}" in text})
