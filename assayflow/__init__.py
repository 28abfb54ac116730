"""assayflow: per-feature biomarker statistics as Spark DataFrame jobs.

Data model: one long table ``(id columns..., feature, level)``. Every operator
takes a DataFrame and returns a DataFrame, so steps chain with
``DataFrame.transform``; nothing is collected to the driver.

Sub-packages:

* ``sources``   - readers (CSV/parquet/table, glob lineage) and sinks
* ``functions`` - column expressions (t distribution, label cleaning, ...)
* ``operators`` - reshape, cohort joins, preprocessing, OLS, t-tests,
                  multiple testing, fold change, outliers/LOD, volcano tables
* ``plans``     - fixture views over the driver tables and end-to-end jobs
"""

__version__ = "0.1.0"
