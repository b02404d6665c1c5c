"""Command line: preprocess, compare models, fit a workflow, predict with a saved one."""

from __future__ import annotations

import argparse
import json
import logging
from typing import Any

from pyspark.sql import SparkSession

from lodewright.operators import models, statistics, validation, workflow
from lodewright.operators.preprocess import DataPreprocessor, STEPS
from lodewright.operators.profile import Roles
from lodewright.sources import store
from lodewright.sources.files import read_data, write_table

log = logging.getLogger("lodewright")
COMPONENTS = ("split", *STEPS, "selector", "developer", "optimiser", "conformal", "domain")


def settings_of(texts: list[str]) -> dict[str, Any]:
    """Settings from `KEY=VALUE` words or one JSON object; values are read as JSON where they can be."""
    out: dict[str, Any] = {}
    for text in texts:
        if text.lstrip().startswith("{"):
            out |= json.loads(text)
            continue
        key, sign, value = text.partition("=")
        if not sign:
            raise ValueError(f"{text} is not KEY=VALUE")
        try:
            out[key] = json.loads(value)
        except json.JSONDecodeError:
            out[key] = value
    return out


def set_up_logging(spark: SparkSession, level: str) -> None:
    """One level for this library's messages; Spark itself reports errors only."""
    logging.basicConfig(format="%(asctime)s %(levelname)s %(name)s: %(message)s", level=level.upper())
    logging.getLogger("py4j").setLevel(logging.WARNING)
    spark.sparkContext.setLogLevel("ERROR")


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="lodewright", description=__doc__)
    parser.add_argument("command", choices=("preprocess", "validate", "fit", "predict"))
    parser.add_argument("input")
    parser.add_argument("output", help="a table, or for fit the folder of the saved workflow")
    parser.add_argument("--model-path", help="a saved workflow, for predict")
    parser.add_argument("--id", default="rec_id")
    parser.add_argument("--activity", default="activity")
    parser.add_argument("--alpha", type=float, nargs="+", help="levels of intervals or label sets, for predict")
    parser.add_argument("--models", nargs="+", default=["Dummy", "KNeighbors", "RandomForest"])
    parser.add_argument("--splits", type=int, default=5)
    parser.add_argument("--repeats", type=int, default=5)
    parser.add_argument("--log-level", default="info")
    for name in COMPONENTS:
        parser.add_argument(f"--{name.replace('_', '-')}", nargs="+", metavar="KEY=VALUE", default=None, help=f"settings of {name}, or one JSON object")
    known = parser.parse_args(args)
    spark = SparkSession.builder.appName("lodewright").getOrCreate()
    set_up_logging(spark, known.log_level)
    roles = Roles(known.id, known.activity)
    given = {n: settings_of(v) for n in COMPONENTS if (v := getattr(known, n)) is not None}
    df = read_data(spark, known.input)
    log.info("%s: %s", known.command, known.input)
    if known.command == "preprocess":
        steps = workflow.Settings(preprocessor={n: given[n] for n in STEPS if n in given}).made(roles)["preprocessor"]
        assert isinstance(steps, DataPreprocessor)
        log.info("written: %s", write_table(steps.fit_transform(df)[1], known.output, numbered=True))
    elif known.command == "validate":
        classes = models.target_type(df, known.activity) == "C"
        cols = roles.features(df)
        fits = {m: (lambda t, m=m: models.fit_model(m, t, cols, known.activity, classes, **validation.own_id(m, roles))) for m in known.models}
        scores = validation.cross_validate(df, fits, roles, classes, known.splits, known.repeats)
        log.info("written: %s", write_table(statistics.cross_validation_report(scores, ["scoring"], known.models), known.output, "csv", numbered=True, single=True))
    elif known.command == "fit":
        developer = {"select": tuple(known.models), "n_splits": known.splits, "n_repeats": known.repeats} | given.get("developer", {})
        if isinstance(developer["select"], list):
            developer["select"] = tuple(developer["select"])
        settings = workflow.Settings(
            split=given.get("split", {"option": "random"}), preprocessor={n: given[n] for n in STEPS if n in given}, selector=given.get("selector"), developer=developer,
            optimiser=given.get("optimiser"), conformal=given.get("conformal"), domain=given.get("domain"),
        )
        log.info("saved: %s", store.save(workflow.Workflow(settings, roles).fit(df), known.output, spark))
    else:
        if not known.model_path:
            parser.error("predict needs --model-path")
        runner = workflow.InferenceRunner(store.load(known.model_path, spark), known.alpha)
        out = runner.run(df, spark, id_key=known.id if known.id in df.columns else None, truth=known.activity if known.activity in df.columns else None)
        log.info("written: %s, %s", write_table(out, known.output, numbered=True), runner.last)


if __name__ == "__main__":
    main()
