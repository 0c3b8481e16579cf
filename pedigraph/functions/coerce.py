"""Loose payload text to domain values, as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Accepted spellings.
TIER_WORDS = {
    "human_genetics": 5, "human genetics": 5, "genetics": 5, "perturbation": 4, "crispr": 4, "perturb-seq": 4,
    "animal": 3, "mouse": 3, "association": 2, "observational": 2, "review": 1, "opinion": 1,
}
POLARITY_WORDS = {
    "supports": ["supports", "support", "positive", "confirm", "supported"],
    "contradicts": ["contradicts", "contradict", "negative", "refute", "refuted", "null"],
    "neutral": ["neutral", "inconclusive"],
}
SIGN_WORDS = {
    "activates": ["activates", "activate", "up", "positive", "risk", "+"],
    "inhibits": ["inhibits", "inhibit", "down", "negative", "protective", "-"],
}
NODE_WORDS = {
    "variant": "variant", "gene": "gene", "perturbation": "perturbation", "mechanism": "mechanism",
    "molecular_mechanism": "mechanism", "cell_state": "cell_state", "cell_phenotype": "cell_phenotype",
    "tissue_pathology": "tissue_pathology", "clinical_outcome": "clinical_outcome", "drug": "drug",
    "biomarker": "biomarker",
}
EXPERIMENT_WORDS = {
    "lof": "loss_of_function", "gof": "gain_of_function", "knockout": "loss_of_function",
    "overexpression": "gain_of_function", "crispr": "crispr_screen", "mouse": "mouse_in_vivo", "human": "human_tissue",
}


def _word(text: Column) -> Column:
    return F.lower(F.trim(text))


def _mapped(text: Column, words: dict, default) -> Column:
    table = F.create_map(*[F.lit(v) for pair in words.items() for v in pair])
    return F.coalesce(F.try_element_at(table, _word(text)), default if isinstance(default, Column) else F.lit(default))


def _grouped(text: Column, groups: dict, default: str) -> Column:
    out = F.lit(default)
    for value, words in groups.items():
        out = F.when(F.coalesce(_word(text).isin(*words), F.lit(False)), F.lit(value)).otherwise(out)
    return out


def tier(text: Column, default: int = 2) -> Column:
    return _mapped(text, TIER_WORDS, default)


def polarity(text: Column) -> Column:
    return _grouped(text, POLARITY_WORDS, "supports")


def sign(text: Column, default: str = "unknown") -> Column:
    return _grouped(text, SIGN_WORDS, default)


def node_type(text: Column) -> Column:
    return _mapped(text, NODE_WORDS, "mechanism")


def experiment_type(text: Column, known: list[str]) -> Column:
    return F.when(_word(text).isin(*known), _word(text)).otherwise(_mapped(text, EXPERIMENT_WORDS, "human_tissue"))


def truth(text: Column, default: bool = False) -> Column:
    return F.when(text.isNull(), F.lit(default)).otherwise(_word(text.cast("string")).isin("true", "yes", "1", "y"))
