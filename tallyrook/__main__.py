"""python -m tallyrook [list|export|scan] [folder]

Scans the source files of a folder (default: samples) and exits with 1 if any
is vulnerable.  The model is models/model.onnx with models/tokenizer.json, or a
pipeline saved in models/fitted; --model FOLDER looks elsewhere, --assume P
takes the probability P for every file instead.
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tallyrook.operators import score
from tallyrook.plans import gate


def main(argv: list[str] | None = None) -> int:
    asked = argparse.ArgumentParser(prog="tallyrook", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    asked.add_argument("--model", default=str(gate.ROOT / "models"), help="folder of the model")
    asked.add_argument("--assume", type=float, help="probability of every file")
    asked.add_argument("command", nargs="?", default="scan")
    asked.add_argument("folder", nargs="?", default="samples")
    said = asked.parse_args(argv)
    spark = SparkSession.builder.appName("tallyrook").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")

    def scorer(code):
        if said.assume is not None:
            p = F.lit(said.assume)
            return code.select("code_id", (p > 0.5).cast("int").alias("label"), p.alias("probability"), F.lit("assumed").alias("model_source"))
        model = Path(said.model)
        return score.resolve(str(model / "model.onnx"), str(model / "fitted"), str(model / "tokenizer.json"))(code)

    try:
        return gate.main(spark, [said.command, said.folder], scorer, complain=lambda x: print(x, file=sys.stderr))
    except FileNotFoundError as e:
        print(f"no model: {e}; give --model or --assume", file=sys.stderr)
        return 2


if __name__ == "__main__":
    raise SystemExit(main())
