"""The lifecycle as a table: which event may follow which state, and where it leads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Lifecycle:
    """Rows of (event_type, predecessor state or None, resulting state)."""

    steps: tuple[tuple[str, str | None, str], ...]

    @property
    def event_types(self) -> list[str]:
        return [event for event, _, _ in self.steps]

    @property
    def states(self) -> list[str]:
        return list(dict.fromkeys(state for _, _, state in self.steps))

    @property
    def is_linear(self) -> bool:
        """True when each step follows the one before it, so a state is a rank."""
        return all(
            before == (None if i == 0 else self.steps[i - 1][2])
            for i, (_, before, _) in enumerate(self.steps)
        )

    def _lookup(self, key: Column, pairs) -> Column:
        out = None
        for name, value in pairs:
            hit = key.eqNullSafe(F.lit(name))
            out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
        return out

    def predecessor(self, event_type: Column) -> Column:
        return self._lookup(event_type, [(e, p) for e, p, _ in self.steps if p is not None])

    def resulting(self, event_type: Column) -> Column:
        return self._lookup(event_type, [(e, s) for e, _, s in self.steps])

    def is_known(self, event_type: Column) -> Column:
        return event_type.isin(self.event_types)

    def is_legal(self, event_type: Column, state: Column) -> Column:
        """An event is legal after exactly one state; NULL means the order is unseen."""
        return F.coalesce(self.is_known(event_type), F.lit(False)) & self.predecessor(
            event_type
        ).eqNullSafe(state)

    def expected_next(self, state: Column) -> Column:
        """The event that should come next, or NULL once the lifecycle is complete."""
        return self._lookup(state, [(p, e) for e, p, _ in self.steps])

    def expected_text(self, state: Column) -> Column:
        return F.coalesce(self.expected_next(state), F.lit("nothing (lifecycle complete)"))

    def rank(self, event_type: Column) -> Column:
        return self._lookup(event_type, [(e, i + 1) for i, (e, _, _) in enumerate(self.steps)])

    def as_dataframe(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            list(self.steps), "event_type string, predecessor string, state string"
        )


#: The prepaid order lifecycle, fixed values.
ORDER_LIFECYCLE = Lifecycle(
    (
        ("ORDER_CREATED", None, "CREATED"),
        ("PACKED", "CREATED", "PACKED"),
        ("SHIPPED", "PACKED", "SHIPPED"),
        ("DELIVERED", "SHIPPED", "DELIVERED"),
    )
)

#: Accepted payment methods, fixed values.
PAYMENT_METHODS = ("CARD", "BKASH", "NAGAD")
