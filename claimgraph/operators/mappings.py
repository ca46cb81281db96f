"""Field mappings between schemas, with provenance.

mappings: (ord BIGINT, source_schema, source_field, target_schema, target_field STRING, confidence DOUBLE,
justification, agent, direction STRING). ord is unique and says which of several mappings of one key came first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import NUMBER, ends, error, prepare, refuse_clashes
from ..functions.kinds import CID, FLOAT, STRING
from ..functions.schema import Schema

DIRECTIONS = ("forward", "reverse", "bidirectional")
KEY = ("source_schema", "source_field", "target_schema", "target_field")
TABLE = "ord long, source_schema string, source_field string, target_schema string, target_field string, confidence double, justification string, agent string, direction string"
DEFAULTS = {"confidence": 0.5, "justification": "", "agent": "unknown", "direction": "forward"}


@dataclass(frozen=True)
class Mapping:
    """One mapping on the driver; build() clamps the confidence, the constructor takes it as it is."""

    source_schema: str
    source_field: str
    target_schema: str
    target_field: str
    confidence: float = 0.5
    justification: str = ""
    agent: str = "unknown"
    direction: str = "forward"

    def __post_init__(self):
        if self.direction not in DIRECTIONS:
            raise ValueError(f"no such direction: {self.direction!r}")

    @staticmethod
    def build(source_schema: str, source_field: str, target_schema: str, target_field: str, confidence: float = 0.5, **rest) -> Mapping:
        c = confidence if confidence != confidence else max(0.0, min(1.0, confidence))
        return Mapping(source_schema, source_field, target_schema, target_field, c, **rest)

    def identity_key(self) -> tuple[str, str, str, str]:
        return self.source_schema, self.source_field, self.target_schema, self.target_field

    def reversed(self) -> Mapping:
        turned = {"forward": "reverse", "reverse": "forward"}.get(self.direction, self.direction)
        return Mapping(self.target_schema, self.target_field, self.source_schema, self.source_field, self.confidence, self.justification, self.agent, turned)


def mapping_schema() -> Schema:
    """The schema of mappings themselves; the direction's text isn't checked by it."""
    s = Schema("mapping", 1)
    for name, kind in zip(KEY, (CID, STRING, CID, STRING)):
        s = s.identity(name, kind)
    return s.required("confidence", FLOAT).required("justification", STRING).required("agent", STRING).required("direction", STRING)


def clamped(c: Column) -> Column:
    """Into [0, 1]; not-a-number stays."""
    return F.when(F.isnan(c), c).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def normalise(mappings: DataFrame) -> DataFrame:
    """Fill defaults, clamp confidences, and raise for a direction that isn't one."""
    d = F.coalesce("direction", F.lit(DEFAULTS["direction"]))
    bad = F.raise_error(F.concat(F.lit("no such direction: "), d))
    return mappings.withColumns({
        "confidence": clamped(F.coalesce("confidence", F.lit(DEFAULTS["confidence"]))),
        "justification": F.coalesce("justification", F.lit(DEFAULTS["justification"])),
        "agent": F.coalesce("agent", F.lit(DEFAULTS["agent"])),
        "direction": F.when(d.isin(*DIRECTIONS), d).otherwise(bad),
    })


def to_json(columns: list[str] | None = None) -> Column:
    """A mapping's row as a JSON object of its eight fields."""
    return F.to_json(F.struct(*(columns or [*KEY, "confidence", "justification", "agent", "direction"])))


def from_json(df: DataFrame, column: str) -> DataFrame:
    """df with the fields of the mapping in a JSON text column, and error (null if it is a mapping).

    Checked in this order: an object, a direction, one of the three, a numeric confidence, then the six texts. Other
    keys are passed over; the confidence isn't clamped. Raises if df has a column of one of these names already.
    """
    names = (*KEY, "confidence", "justification", "agent", "direction", "error")
    refuse_clashes(df, names)
    prepare(df.sparkSession)
    col = lambda n: F.col(f"__mapping_{n}")
    put = lambda d, cols: d.withColumns({f"__mapping_{k}": v for k, v in cols.items()})
    # A column for each step, so that a member is looked up once.
    rows = put(df, {"v": F.when(ends(F.col(column)), F.try_parse_json(F.col(column)))})
    rows = put(rows, {n: F.variant_get(col("v"), f"$.{n}", "variant") for n in names[:-1]} | {"root": F.schema_of_variant(col("v"))})
    rows = put(rows, {f"kind_{n}": F.schema_of_variant(col(n)) for n in names[:-1]})
    texts = [n for n in names[:-1] if n != "confidence"]
    is_text = lambda n: F.coalesce(col(f"kind_{n}") == "STRING", F.lit(False))
    number = F.coalesce(col("kind_confidence").rlike(NUMBER), F.lit(False))
    values = {n: F.when(is_text(n), F.try_variant_get(col(n), "$", "string")) for n in texts}
    values["confidence"] = F.when(number, F.try_variant_get(col("confidence"), "$", "double"))
    rows = put(rows, {f"value_{n}": v for n, v in values.items()})
    missing = lambda n: error("missing_field", n, None, None, F.lit(f"missing or invalid field: {n}"))
    direction = col("value_direction")
    checks = [
        F.when(col("v").isNull(), error("serde", None, None, None, F.lit("serialization error: not JSON"))),
        F.when(~col("root").startswith("OBJECT"), error("type_mismatch", "<root>", "object", None, F.lit("expected JSON object"))),
        F.when(direction.isNull(), missing("direction")),
        F.when(~direction.isin(*DIRECTIONS), error("type_mismatch", "direction", "|".join(DIRECTIONS), None, F.concat(F.lit("invalid direction: "), direction))),
        F.when(~number, missing("confidence")),
        *[F.when(~is_text(n), missing(n)) for n in (*KEY, "justification", "agent")],
    ]
    made = [c for c in rows.columns if c.startswith("__mapping_")]
    return rows.withColumns({n: col(f"value_{n}") for n in names[:-1]} | {"error": F.coalesce(*checks)}).drop(*made)


def reversed_mappings(mappings: DataFrame) -> DataFrame:
    """Ends swapped; forward and reverse swap, bidirectional stays."""
    d = F.when(F.col("direction") == "forward", "reverse").when(F.col("direction") == "reverse", "forward").otherwise(F.col("direction"))
    swapped = dict(zip(KEY, (KEY[2], KEY[3], KEY[0], KEY[1])))
    return mappings.select(*[F.col(swapped.get(c, c)).alias(c) if c != "direction" else d.alias(c) for c in mappings.columns])


def by_key(mappings: DataFrame) -> DataFrame:
    """(key, count): mappings of each identity key."""
    return mappings.groupBy(*KEY).agg(F.count(F.lit(1)).alias("count"))
