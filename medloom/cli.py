"""Commands: pipeline, query, metadata, labels, training, rewards.  Models are those of the configuration."""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence

from medloom.config import load_config
from medloom.operators.warehouse import open_tables
from medloom.plans.pipeline import STAGES, Pipeline
from medloom.plans.service import QueryService
from medloom.session import build_session


def main(argv: Sequence[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="medloom")
    parser.add_argument("--config", required=True)
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("pipeline")
    run.add_argument("--stages", nargs="*", default=list(STAGES))
    run.add_argument("--no-resume", action="store_true")
    query = commands.add_parser("query")
    query.add_argument("sql")
    query.add_argument("--strict", action="store_true")
    commands.add_parser("metadata")
    commands.add_parser("records")
    commands.add_parser("labels")
    commands.add_parser("training")
    commands.add_parser("rewards").add_argument("summaries")
    args = parser.parse_args(argv)
    config, spark = load_config(args.config), build_session()
    if args.command == "query":
        q = config.query
        service = QueryService(spark, open_tables(spark, f"{config.output_dir}/database"), q.min_cell_size, q.max_query_rows, config.database.forbidden_output_columns, config.name, args.strict, q.max_output_fraction if q.enforce_output_fraction else None)
        print(json.dumps(service.execute(args.sql), default=str))
    elif args.command == "records":
        Pipeline(spark, config).records()
    elif args.command == "labels":
        Pipeline(spark, config).labels()
    elif args.command == "training":
        Pipeline(spark, config).training()
    elif args.command == "rewards":
        Pipeline(spark, config).rewards(args.summaries)
    else:
        stages = ["metadata"] if args.command == "metadata" else args.stages
        Pipeline(spark, config).run(stages, not getattr(args, "no_resume", False))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
