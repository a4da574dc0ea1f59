"""Predicates and derivations over one event record and its nested steps.

A record's steps are one document, so row-local array functions are the right tool: no shuffle.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from countersign.functions.headers import _col

DAY_MS = 86_400_000.0


def _none(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _list(c: Column, kind: str) -> Column:
    return F.coalesce(c, F.array().cast(kind))


def is_complete(status: Column | str = "status") -> Column:
    """P37."""
    return _none(_col(status) == "complete")


def find_step(steps: Column | str, step_id: Column | str) -> Column:
    """P37."""
    return F.get(F.filter(_col(steps), lambda s: s["id"] == _col(step_id)), F.lit(0))


def expand_flow(steps: Column | str, flow: Column | str) -> Column:
    """P35. Turn `flow` into each step's dependsOn; fill status and commit_sequence."""
    src, kind = _col(steps), F.coalesce(F.nullif(_col(flow), F.lit("")), F.lit("sequential"))
    none = F.array().cast("array<string>")

    def expand(s: Column, i: Column) -> Column:
        chain = F.when(i == 0, none).otherwise(F.array(F.get(src, i - 1)["id"]))
        deps = (
            F.when(kind == "parallel", none)
            .when(kind == "custom", F.coalesce(s["dependsOn"], none))
            .otherwise(chain)
        )
        return (
            s.withField("status", F.coalesce(s["status"], F.lit("pending")))
            .withField("dependsOn", deps)
        )

    return F.transform(src, expand)


def deps_met(step: Column, steps: Column | str) -> Column:
    """J4 within a record: every dependency names a complete step."""
    done = F.transform(F.filter(_col(steps), lambda s: is_complete(s["status"])), lambda s: s["id"])
    return F.forall(
        _list(step["dependsOn"], "array<string>"), lambda d: _none(F.array_contains(done, d))
    )


def eligible_steps(steps: Column | str) -> Column:
    """J5. Steps that are not complete and wait for nothing."""
    return F.filter(_col(steps), lambda s: ~is_complete(s["status"]) & deps_met(s, steps))


def first_pending_step(steps: Column | str) -> Column:
    """W5."""
    return F.get(F.filter(_col(steps), lambda s: ~is_complete(s["status"])), F.lit(0))


def all_steps_complete(steps: Column | str, manual: Column | str) -> Column:
    """A3."""
    return _none(F.forall(_col(steps), lambda s: is_complete(s["status"]))) & ~_none(_col(manual))


def step_levels(steps: Column | str) -> Column:
    """Longest dependency chain below each step, as an array parallel to `steps`.

    A complete step waits for nothing any more and gets 0. A step that needs an unknown step, or sits on or behind a cycle, gets -1: no reply ever
    completes it.
    """
    src = _col(steps)
    ids = F.transform(src, lambda s: s["id"])

    def relax(levels: Column, _round: Column) -> Column:
        def level(s: Column) -> Column:
            below = F.transform(
                _list(s["dependsOn"], "array<string>"),
                lambda d: F.coalesce(
                    F.try_element_at(levels, F.nullif(F.array_position(ids, d).cast("int"), F.lit(0))),
                    F.lit(-1),
                ),
            )
            return (
                F.when(is_complete(s["status"]) | (F.size(below) == 0), F.lit(0))
                .when(F.array_min(below) < 0, F.lit(-1))
                .otherwise(F.array_max(below) + 1)
            )

        return F.transform(src, level)

    start = F.transform(src, lambda s: F.lit(-1))
    # n rounds settle a graph of n steps.
    rounds = F.when(F.size(src) > 0, F.sequence(F.lit(1), F.size(src))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(rounds, start, relax)


def is_active(prefix: str = "") -> Column:
    """F4. Activated, not archived, not complete."""
    p = f"{prefix}." if prefix else ""
    return (
        F.col(f"{p}activated_at").isNotNull()
        & F.col(f"{p}archived_at").isNull()
        & ~is_complete(f"{p}status")
    )


def reference_clock(type_: Column | str, steps: Column | str, activated_at: Column | str) -> Column:
    """A5. Latest deadline of a pending step (workflow), else the activation time."""
    deadlines = F.transform(
        F.filter(_col(steps), lambda s: ~is_complete(s["status"])),
        # A plain date, or a full ISO date-time.
        lambda s: F.coalesce(F.try_to_timestamp(s["deadline"], F.lit("yyyy-MM-dd")), s["deadline"].try_cast("timestamp")),
    )
    latest = F.when(_col(type_) == "workflow", F.array_max(deadlines))
    activated = _col(activated_at)
    return F.when(activated.isNotNull(), F.coalesce(latest, activated))


def days_over(now: Column, clock: Column | str) -> Column:
    """P40. Fractional days since the clock."""
    return (F.unix_millis(now) - F.unix_millis(_col(clock))) / F.lit(DAY_MS)
