"""python -m maskmetrics CONFIG.json"""

import argparse
import logging

from pyspark.sql import SparkSession

from .plans.evaluate import Evaluation
from .sources import json_files


def main(arguments: list[str] | None = None) -> dict:
    parser = argparse.ArgumentParser(prog="maskmetrics", description="Evaluates anonymizations of a corpus.")
    parser.add_argument("config_file_path")
    path = parser.parse_args(arguments).config_file_path
    logging.basicConfig(level=logging.INFO)
    config = json_files.read_config(path)
    spark = SparkSession.builder.appName("maskmetrics").getOrCreate()
    evaluation = Evaluation.of_file(spark, config["corpus"])
    return evaluation.evaluate(*json_files.read_anonymizations(spark, config["anonymizations"]), config["metrics"], config["results_file_path"])


if __name__ == "__main__":
    main()
