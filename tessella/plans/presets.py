"""Parameters of whole linkage runs, and the run itself."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import blocking as B
from ..operators import candidates as C


@dataclass(frozen=True)
class Linkage:
    """What a run does; immutable, and convertible to and from plain dicts."""

    names: tuple[str, ...] = ("clean", "core", "sorted")
    address: dict = field(default_factory=lambda: {"cap": 30, "pin": False, "pin_number": True, "pin_token": False, "locality_number": True})
    rare: dict = field(default_factory=lambda: {"max_df": 200, "n": 2, "min_length": 3, "cap": 30})
    char: dict = field(default_factory=lambda: {"k": 20, "least": 0.25, "min_df": 2, "max_df": 0.9, "reverse": 0})
    translit: dict = field(default_factory=lambda: {"max_df": 150, "min_length": 4, "cap": 30})
    prune: dict | None = None

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, d: dict) -> Linkage:
        return cls(**{k: tuple(v) if k == "names" else v for k, v in d.items()})

    @classmethod
    def load(cls, path: str) -> Linkage:
        """From a file of JSON, or of YAML where a reader for it is installed."""
        text = Path(path).read_text()
        if path.endswith((".yaml", ".yml")):
            import yaml

            return cls.from_dict(yaml.safe_load(text))
        return cls.from_dict(json.loads(text))


BASE = Linkage()
PRESETS = {
    "defaults": replace(BASE, prune={"max_cands": 50, "top_k": 20}),
    "runner": replace(BASE, char=BASE.char | {"reverse": 1}, prune={"max_cands": 50, "top_k": 20, "quota": 4}),
    "full_test": replace(BASE, rare=BASE.rare | {"max_df": 100, "cap": 300}, char=BASE.char | {"reverse": 1}),
    "smoke": replace(BASE, rare=BASE.rare | {"max_df": 150, "cap": 300}, char=BASE.char | {"reverse": 1}),
    "yaml": replace(BASE, address=BASE.address | {"cap": 500, "locality_number": False}, rare=BASE.rare | {"max_df": 100, "cap": 300}, char=BASE.char | {"reverse": 1}),
}


def candidates(queries: DataFrame, targets: DataFrame, run: Linkage = BASE) -> DataFrame:
    """(s1_id, cand_id, strategies) of the five blockers, pruned if the run asks for it."""
    parts = {
        "exact_name": B.exact_names(queries, targets, run.names),
        "address": B.by_address(queries, targets, **run.address),
        "rare_token": B.rare_tokens(queries, targets, **run.rare),
        "char_retrieval_reciprocal" if run.char.get("reverse") else "char_retrieval": B.char_retrieval(queries, targets, **run.char),
        "transliteration": B.translit_names(queries, targets, **run.translit),
    }
    out = C.union(parts)
    return C.prune_quota(out, queries, targets, **run.prune) if run.prune else out


def in_country(df: DataFrame, country: str, most: int | None = None) -> DataFrame:
    d = df.where(F.col("country") == country)
    return d if most is None else d.limit(most)
