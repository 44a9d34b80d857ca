"""Command line for the jobs.

  python -m waypoint ingest --cust CUST.csv --tx TX_FOLDER --cache CACHE
  python -m waypoint model --cache CACHE --survey-cust C.csv --survey-tx F --survey-map M.csv \\
      --responses RESP.parquet [--alt ALT.csv] [--codebook BOOK.csv] --brand CODE [--segmentation NAME] \\
      [--default-segment LEVEL] [--year Y] [--unit-cap N] [--spend-step N] [--spend-cap N] \
      [--extract-fraction F] [--testing --sample-size N] [--seed S] [--on-uncovered error|default] \
      --out OUT
  python -m waypoint analyses (as model) [--only NAME ...] [--customer CCID ...] --out OUT
  python -m waypoint respondents --survey-cust ... --responses RESP.parquet --year Y --out OUT

The session is taken from the environment (``spark-submit`` settings); the
stage tables go under ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from waypoint.params import ModelParams
from waypoint.plans import jobs


def _survey(spark, a) -> jobs.SurveyInputs:
    return jobs.SurveyInputs(cust_csv=a.survey_cust, tx_folder=a.survey_tx, map_csv=a.survey_map,
                             responses=spark.read.parquet(a.responses),
                             alt_csv=getattr(a, "alt", None), codebook_csv=a.codebook)


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="waypoint")
    sub = ap.add_subparsers(dest="cmd", required=True)
    i = sub.add_parser("ingest")
    i.add_argument("--cust", required=True)
    i.add_argument("--tx", required=True)
    i.add_argument("--cache", required=True)
    for name in ("model", "analyses", "respondents"):
        s = sub.add_parser(name)
        s.add_argument("--survey-cust", required=True)
        s.add_argument("--survey-tx", required=True)
        s.add_argument("--survey-map", required=True)
        s.add_argument("--responses", required=True)
        s.add_argument("--codebook")
        s.add_argument("--out", required=True)
        s.add_argument("--year", type=int, default=ModelParams().analysis_year)
    d = ModelParams()
    for m in (sub.choices["model"], sub.choices["analyses"]):
        m.add_argument("--cache", required=True)
        m.add_argument("--alt")
        m.add_argument("--brand", required=True)
        m.add_argument("--segmentation")
        m.add_argument("--default-segment", default=d.default_segment)
        m.add_argument("--testing", action="store_true")
        m.add_argument("--unit-cap", type=int, default=d.unit_cap)
        m.add_argument("--spend-step", type=int, default=d.spend_step)
        m.add_argument("--spend-cap", type=int, default=d.spend_cap)
        m.add_argument("--extract-fraction", type=float, default=d.extract_fraction)
        m.add_argument("--sample-size", type=int, default=d.sample_size)
        m.add_argument("--seed", type=int, default=d.seed)
        m.add_argument("--on-uncovered", choices=("error", "default"), default=d.on_uncovered)
    sub.choices["analyses"].add_argument("--only", nargs="*", default=())
    sub.choices["analyses"].add_argument("--customer", nargs="*", type=int, default=())
    a = ap.parse_args(argv)

    spark = SparkSession.builder.appName(f"waypoint-{a.cmd}").getOrCreate()
    if a.cmd == "ingest":
        for r in jobs.ingest_job(spark, a.cust, a.tx, a.cache).orderBy("source", "column_name", "kind").collect():
            print(r.source, r.column_name, r.kind, r.n)  # a row a column
    elif a.cmd in ("model", "analyses"):
        p = ModelParams(analysis_year=a.year, brand=a.brand, segmentation=a.segmentation,
                        default_segment=a.default_segment, testing=a.testing,
                        unit_cap=a.unit_cap, spend_step=a.spend_step, spend_cap=a.spend_cap,
                        extract_fraction=a.extract_fraction, sample_size=a.sample_size,
                        seed=a.seed, on_uncovered=a.on_uncovered)
        if a.cmd == "model":
            paths = jobs.model_job(spark, a.cache, _survey(spark, a), p, a.out)
        else:
            paths = jobs.analyses_job(spark, a.cache, _survey(spark, a), p, a.out, only=tuple(a.only),
                                      customers=tuple(a.customer))
        for name, path in paths.items():
            print(name, path)
    else:
        print(jobs.respondent_job(spark, _survey(spark, a), a.year, a.out))


if __name__ == "__main__":
    main()
