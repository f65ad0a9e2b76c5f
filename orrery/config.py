"""Settings: how tables and columns are named, and the parameters of layout and tiles."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.labels import valid_suffix


@dataclass(frozen=True)
class Forces:
    """Parameters of the layout's forces."""

    link_strength: float = 1.17
    falloff_rsq: float = 1e6
    close_a: float = 1e9
    close_b: float = 1e14
    close_c: float = 1.1
    close_d: float = 0.6
    use_ref_freq: bool = True
    close_repulsion: bool = False

    def adjusted(self, **factors: float) -> Forces:
        """With some parameters multiplied."""
        return replace(self, **{k: getattr(self, k) * f for k, f in factors.items()})


@dataclass(frozen=True)
class Binding:
    """A logical table's physical name and columns; a logical column bound to an empty name isn't available."""

    table: str
    columns: dict[str, str]

    def read(self, spark: SparkSession, folder: str, suffix: str = "") -> DataFrame:
        """The logical columns that are available, under their logical names."""
        if suffix and not valid_suffix(suffix):
            raise ValueError(f"not a table suffix: {suffix!r}")
        df = spark.read.parquet(f"{folder}/{self.table}{'_' + suffix if suffix else ''}.parquet")
        return df.select(*[F.col(physical).alias(logical) for logical, physical in self.columns.items() if physical])


@dataclass(frozen=True)
class Settings:
    """All settings; what a file leaves out has the defaults here."""

    mass_exponent: float = 1.0
    external_cites: bool = False
    add_missing_categories: bool = False
    orient_category: str = ""
    orient_angle: float = 0.0
    forces: Forces = Forces()
    max_tile_division: int = 256
    max_label_division: int = 32
    outline: bool = False
    cold: tuple[float, ...] = (0.15, 0.15, 0.25)
    warm: tuple[float, ...] = (1.0, 0.15, 0.25)
    where: str = ""
    extra: str = ""
    search_map_only: bool = False
    tables: dict[str, Binding] = field(default_factory=dict)


#: Settings' names of the force parameters.
_FORCES = {
    "link_strength": "link_strength", "anti_gravity_falloff_rsq": "falloff_rsq", "close_repulsion_a": "close_a", "close_repulsion_b": "close_b", "close_repulsion_c": "close_c",
    "close_repulsion_d": "close_d", "use_ref_freq": "use_ref_freq", "initial_close_repulsion": "close_repulsion",
}


def load_settings(path: str | Path) -> Settings:
    """Settings from a JSON file; whole numbers stand for reals where reals are meant."""
    raw = json.loads(Path(path).read_text())
    body, tiles, sql = raw.get("nbody", {}), raw.get("tiles", {}), raw.get("sql", {})
    forces = {ours: type(getattr(Forces(), ours))(body["forces"][name]) for name, ours in _FORCES.items() if name in body.get("forces", {})}
    tables = {}
    for name, spec in sql.items():
        tables[name.removesuffix("_table")] = Binding(spec["name"], {k.removeprefix("field_"): v.lower() for k, v in spec.items() if k.startswith("field_")})
    meta, turn, hot = sql.get("meta_table", {}), body.get("map_orientation", {}), tiles.get("heatmap", {})
    return Settings(
        float(body.get("mass_cites_exponent", 1.0)), bool(body.get("use_external_cites", False)), bool(body.get("add_missing_cats", False)), turn.get("category", ""), float(turn.get("angle", 0.0)),
        Forces(**forces), int(tiles.get("max_tile_division", 256)), int(tiles.get("max_label_division", 32)), bool(tiles.get("draw_paper_outline", False)),
        tuple(map(float, hot.get("cold_col", Settings.cold))), tuple(map(float, hot.get("warm_col", Settings.warm))), meta.get("where_clause", ""), meta.get("extra_clause", ""),
        bool(raw.get("webserver", {}).get("search_map_only", False)), tables,
    )
