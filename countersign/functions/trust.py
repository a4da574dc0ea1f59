"""Trust grading from an authentication verdict."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from countersign.functions.headers import _col

# fixed values: trust levels, strongest first
TRUST_LEVELS = ("verified", "forwarded", "authorized", "unverified")


def _truthy(c: Column) -> Column:
    return F.coalesce(c.cast("string").isNotNull() & (c.cast("string") != ""), F.lit(False))


def _passed(result: Column) -> Column:
    return F.coalesce(result == "pass", F.lit(False))


def classify_trust(auth: Column | str) -> Column:
    """P18. An ARC pass outranks SPF, and needs no DKIM failure."""
    a = _col(auth)
    aligned = F.coalesce(
        F.exists(
            a["dkim"]["results"],
            lambda r: _passed(r["status"]["result"]) & _truthy(r["status"]["aligned"]),
        ),
        F.lit(False),
    )
    dmarc = _passed(a["dmarc"]["status"]["result"])
    verified, forwarded, authorized, unverified = TRUST_LEVELS
    return (
        F.when(aligned & dmarc, verified)
        .when(_passed(a["arc"]["status"]["result"]), forwarded)
        .when(_passed(a["spf"]["status"]["result"]) & dmarc, authorized)
        .otherwise(unverified)
    )


def trust_rank(level: Column | str) -> Column:
    """P19. 0 is strongest; an unknown level gets a rank weaker than all."""
    pos = F.array_position(F.array(*[F.lit(x) for x in TRUST_LEVELS]), _col(level))
    return F.when(pos > 0, (pos - 1).cast("int")).otherwise(F.lit(2_147_483_647))


def meets_trust(level: Column | str, minimum: Column | str) -> Column:
    """P19. A step that sets no minimum asks for `verified`."""
    floor = F.coalesce(F.nullif(_col(minimum), F.lit("")), F.lit(TRUST_LEVELS[0]))
    return trust_rank(level) <= trust_rank(floor)


def summarise_auth(auth: Column | str) -> Column:
    """P20. The part of a verdict the ledger keeps."""
    a = _col(auth)
    results = a["dkim"]["results"]

    def signature(r: Column) -> Column:
        return F.struct(
            r["status"]["result"].alias("result"),
            F.nullif(r["status"]["comment"], F.lit("")).alias("comment"),
            F.nullif(r["signingDomain"], F.lit("")).alias("domain"),
            F.nullif(r["selector"], F.lit("")).alias("selector"),
            F.nullif(r["status"]["aligned"], F.lit("")).alias("aligned"),
            F.nullif(r["algo"], F.lit("")).alias("algorithm"),
            F.nullif(r["info"], F.lit("")).alias("info"),
        )

    signed = F.coalesce(F.size(results) > 0, F.lit(False))
    return F.struct(
        F.struct(
            F.when(~signed, F.lit("none")).alias("result"),
            F.when(signed, F.transform(results, signature)).alias("signatures"),
        ).alias("dkim"),
        F.when(a["spf"].isNotNull(), F.struct(a["spf"]["status"]["result"].alias("result"))).alias("spf"),
        F.when(a["dmarc"].isNotNull(), F.struct(a["dmarc"]["status"]["result"].alias("result"))).alias("dmarc"),
        F.when(
            a["arc"].isNotNull(),
            F.struct(
                a["arc"]["status"]["result"].alias("result"),
                F.nullif(a["arc"]["status"]["comment"], F.lit("")).alias("comment"),
                F.coalesce(a["arc"]["i"], F.lit(0)).alias("chain_length"),
            ),
        ).alias("arc"),
    )


def pick_signature_to_archive(auth: Column | str) -> Column:
    """P21. Passing and aligned, else passing, else the first."""
    results = _col(auth)["dkim"]["results"]
    passing = F.filter(results, lambda r: _passed(r["status"]["result"]))
    aligned = F.filter(passing, lambda r: _truthy(r["status"]["aligned"]))
    return F.coalesce(F.get(aligned, F.lit(0)), F.get(passing, F.lit(0)), F.get(results, F.lit(0)))


def pick_signer(dkim: Column | str) -> Column:
    """P22. From a ledger entry's summary: passing with domain and selector, else any with both."""
    named = F.filter(
        _col(dkim)["signatures"], lambda s: _truthy(s["domain"]) & _truthy(s["selector"])
    )
    passing = F.filter(named, lambda s: _passed(s["result"]))
    return F.coalesce(F.get(passing, F.lit(0)), F.get(named, F.lit(0)))


def resolve_upgrade(level: Column | str) -> Column:
    """P43. `(upgrade_to, reason)` for a contested entry."""
    lv = _col(level)
    best, *lower = TRUST_LEVELS
    upgradable = F.coalesce(lv.isin(*lower), F.lit(False))
    return F.struct(
        F.when(upgradable, F.lit(best)).alias("upgrade_to"),
        F.when(lv == best, F.lit("already verified"))
        .when(~upgradable, F.concat(F.lit("unknown source trust level: "), F.coalesce(lv, F.lit("undefined"))))
        .alias("reason"),
    )
