"""Study configuration: the original notebooks' config keys as one frozen
dataclass, and runners that hand them to the jobs.

``StudyConfig.from_nested`` accepts the nested mapping a user already has
(e.g. a parsed YAML file with ``data.*``, ``analysis.*``, ``files.*``,
``wide2long.*`` and ``preprocessing.*`` sections); missing keys keep their
defaults.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession

from assayflow.plans import jobs
from assayflow.sources.readers import read_source

# Fixed mapping: nested config key -> StudyConfig field.
CONFIG_KEYS = {
    "data.table_name": "table_name",
    "data.selected_columns": "selected_columns",
    "analysis.covariate": "covariate",
    "analysis.independent_variable_list": "independent_variable_list",
    "analysis.time_point": "time_point",
    "analysis.result_path": "result_path",
    "files.pheno": "pheno",
    "files.manifest": "manifest",
    "files.sample_metadata": "sample_metadata",
    "files.metab.serum": "metab_serum",
    "files.cytokine.serum": "cytokine_serum",
    "files.grand_table_path": "grand_table_path",
    "wide2long.id_vars_base": "id_vars_base",
    "preprocessing.steps": "steps",
    "preprocessing.fill_na.impute_strategy": "impute_strategy",
    "preprocessing.drop_na.dropping_thres": "dropping_thres",
}


@dataclass(frozen=True)
class StudyConfig:
    table_name: str | None = None
    selected_columns: tuple[str, ...] = ()
    covariate: str | None = None
    independent_variable_list: tuple[str, ...] = ()
    time_point: str | None = None
    result_path: str | None = None
    pheno: str | None = None
    manifest: str | None = None
    sample_metadata: str | None = None
    metab_serum: str | None = None
    cytokine_serum: str | None = None
    grand_table_path: str | None = None
    id_vars_base: tuple[str, ...] = ()
    steps: tuple[str, ...] = ("scale",)
    impute_strategy: str = "uniform"
    dropping_thres: float = 0.9

    @classmethod
    def from_nested(cls, cfg: Mapping) -> StudyConfig:
        values = {}
        for dotted, name in CONFIG_KEYS.items():
            node = cfg
            for part in dotted.split("."):
                if not isinstance(node, Mapping) or part not in node:
                    node = None
                    break
                node = node[part]
            if node is not None:
                values[name] = tuple(node) if isinstance(node, (list, tuple)) else node
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in values.items() if k in known})


def run_regression(spark: SparkSession, cfg: StudyConfig) -> DataFrame:
    """The regression notebook (D7) from a config."""
    return jobs.regression_job_from_table(
        spark, cfg.table_name, cfg.selected_columns, covariate=cfg.covariate,
        independent_variables=cfg.independent_variable_list, time_point=cfg.time_point,
        result_path=cfg.result_path)


def run_preprocessing(spark: SparkSession, cfg: StudyConfig, *, fmt: str = "csv",
                      raw_data: bool = False) -> DataFrame:
    """The preprocessing notebook (D1 -> D2 -> D4 -> D5) from a config."""
    meta = jobs.load_metadata(spark, cfg.pheno, cfg.manifest, cfg.sample_metadata, fmt=fmt)
    assay = read_source(spark, cfg.metab_serum, fmt, string_columns=["sample_id"])
    return jobs.preprocessing_job(spark, assay, meta, cfg.grand_table_path,
                                  id_vars=cfg.id_vars_base, steps=cfg.steps,
                                  impute_strategy=cfg.impute_strategy,
                                  dropping_thres=cfg.dropping_thres, raw_data=raw_data)
