"""Small rules as columns: which payments count, what a source or a category means, and how strong evidence is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least amounts that count, in cents, by asset; and for all others.
LEAST, LEAST_OTHER = {"USDT": 100, "USDC": 100, "COIN": 50}, 10
#: What a stop's code says, by the part before its colon.
SINKS = {"pool": "pooled with others", "cj": "joined with others", "none": "no address"}
SOURCE_FAMILIES = {"registry": "official lists", "crowd": "reports", "model": "own findings"}
THREAT_WORDS = {"terror": "terrorism", "proliferation": "sanctions", "cyber": "ransomware", "fraud": "scam"}


def lookup(table: dict, key: Column, default=None) -> Column:
    found = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]
    return found if default is None else F.coalesce(found, F.lit(default))


def direction(own: Column, sender: Column) -> Column:
    return F.when(sender == own, "out").otherwise("in")


def least_amount(asset: Column) -> Column:
    return lookup(LEAST, asset, LEAST_OTHER)


def is_dust(asset: Column, amount: Column) -> Column:
    return (amount <= 0) | (amount < least_amount(asset))


def pays(asset: Column) -> Column:
    """Unknown tokens carry their contract behind an @ and are no payment."""
    return ~asset.contains("@")


def is_plain(address: Column) -> Column:
    """Not a pseudo-address: no prefix, and not all zeros."""
    return ~address.contains(":") & ~address.rlike("^[0x]*$")


def sink_reason(code: Column) -> Column:
    return lookup(SINKS, F.split_part(code, F.lit(":"), F.lit(1)), "other")


def map_category(category: Column, entity: Column, promoted: list[str]) -> Column:
    """The category that counts: contracts demoted, promoted names raised, custodial names exchanges."""
    return (
        F.when(F.lower(entity).rlike(r"\b(token|deployer|airdrop)\b"), "contract").when(entity.isin(promoted), "exchange")
        .when(category.isin("custodial", "otc"), "exchange").when(category == "dex", "swap").otherwise(F.coalesce(category, F.lit("unknown")))
    )


def owner_of(label: Column) -> Column:
    """The owner that a label names: without numbering, wallet words and what is in brackets."""
    bare = F.regexp_replace(F.regexp_replace(label, r"\([^)]*\)", ""), r"(?i)\s+(hot|cold)?\s*wallet.*$", "")
    return F.trim(F.regexp_replace(bare, r"\s+#?\d+$", ""))


def iso_date(text: Column) -> Column:
    """m/d/y as y-m-d; other text as it is."""
    parts = [F.regexp_extract(text, r"^(\d{1,2})/(\d{1,2})/(\d{4})$", k) for k in (1, 2, 3)]
    return F.when(parts[2] != "", F.concat_ws("-", parts[2], F.lpad(parts[0], 2, "0"), F.lpad(parts[1], 2, "0"))).otherwise(text)


def regime_threat(regime: Column) -> Column:
    out = F.lit(None).cast("string")
    for word, threat in reversed(THREAT_WORDS.items()):
        out = F.when(F.lower(regime).contains(word), threat).otherwise(out)
    return out


def source_family(source: Column) -> Column:
    """The first part of a `+`-joined source that is known, in words."""
    known = F.filter(F.split(source, r"\+"), lambda p: p.isin(list(SOURCE_FAMILIES)))
    return F.coalesce(lookup(SOURCE_FAMILIES, F.get(known, F.lit(0))), F.lit("others"))


def frozen_text(by: Column, ts: Column) -> Column:
    return F.concat(F.lit("Frozen by "), by, F.lit(" on "), F.date_format(ts, "d MMM yyyy"))


def strength(p: Column, ppmi: Column) -> Column:
    """Evidence of association, 0 to 1, from a p value and a positive pointwise mutual information."""
    cap = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    return F.sqrt(cap(-F.log10(F.greatest(p, F.lit(1e-300))) / 12) * cap(ppmi / 4))


DISTANCE_WEIGHT = [1.0, 0.8, 0.6]


def points(base: Column, extra: Column, share: Column, hops: Column) -> Column:
    """base, and extra by the share and the distance, rounded half to even, 100 at most."""
    near = F.element_at(F.array(*map(F.lit, DISTANCE_WEIGHT)), F.least(F.greatest(hops, F.lit(1)), F.lit(len(DISTANCE_WEIGHT))).cast("int"))
    return F.least(base + F.bround(extra * F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * near, 0).cast("long"), F.lit(100))


def amount_text(cents: Column, asset: Column) -> Column:
    """Whole units from a thousand on, two decimals below."""
    whole = cents / 100
    return F.concat(F.when(whole >= 1000, F.format_number(whole, 0)).otherwise(F.format_number(whole, 2)), F.lit(" "), asset)


def hops_text(hops: Column) -> Column:
    return F.concat(hops.cast("string"), F.when(hops == 1, " hop").otherwise(" hops"))


def elapsed_text(seconds: Column) -> Column:
    """A span in two compact units."""
    part = lambda size, name, below: F.concat(F.floor(seconds / size).cast("string"), F.lit(f"{name} "), F.floor(seconds % size / below[0]).cast("string"), F.lit(below[1]))
    return F.when(seconds >= 86400, part(86400, "d", (3600, "h"))).when(seconds >= 3600, part(3600, "h", (60, "m"))).when(seconds >= 60, part(60, "m", (1, "s"))).otherwise(F.concat(seconds.cast("string"), F.lit("s")))


def route_of(chain: Column, home: str, treaty: list[str]) -> Column:
    return F.when(chain == home, "domestic").when(chain.isin(treaty), "direct").otherwise("offshore")


def routable(hops: Column, confidence: Column, named: Column, n_wallets: Column, bar: float) -> Column:
    return (hops >= 1) & (confidence >= bar) & named.isNotNull() & (n_wallets > 0)


def chain_status(asked: Column, covered: Column) -> Column:
    """How far a source covers the chains that are asked for."""
    missing = F.size(F.array_except(asked, covered))
    return F.when(missing == 0, "all").when(missing == F.size(asked), "none").otherwise("some")


def digest(*columns: Column) -> Column:
    """SHA-256 of the columns as one JSON array in the order given, doubles to six digits."""
    return F.sha2(F.to_json(F.array(*[c.cast("string") for c in columns])).cast("binary"), 256)
