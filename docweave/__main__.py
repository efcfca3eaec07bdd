"""python -m docweave SOURCE DEST [--output DIR]: map two schema files. Exit 0: fine, 1: the document has faults, 2: bad input."""

from __future__ import annotations

import argparse
import sys
from dataclasses import replace

from pyspark.sql import SparkSession

from docweave.operators.adjudicate import Replay
from docweave.operators.assemble import review_list
from docweave.operators.ledger import BudgetExceeded, by_stage, check_budget, model_prices, priced, totals, what_if
from docweave import settings
from docweave.plans.run import map_schemas
from docweave.sinks import writers
from docweave.sources import calls, reader
from docweave.sources.knowledge import default_pack, read_pack
from docweave.types import SchemaError


def parser(given: settings.Settings) -> argparse.ArgumentParser:
    """Options; what an environment variable sets is their default."""
    p = argparse.ArgumentParser(prog="docweave", description="Map a relational schema to a document schema.")
    p.add_argument("source", help="DDL or JSON file")
    p.add_argument("dest", help="JSON schema or sample documents")
    p.add_argument("--output", help="folder for the mapping and report tables, in any store that Spark writes to")
    p.add_argument("--runs", help="folder in which the whole run is kept: mapping, report, calls, prompts, events")
    p.add_argument("--trace", help="folder for the prompts as they were put, and what came back")
    p.add_argument("--knowledge", help="JSON knowledge pack in place of the built-in one")
    p.add_argument("--records", help="folder of recorded calls to replay in place of the deterministic adjudicator")
    p.add_argument("--strong-model", help="id of the recorded calls' strong model")
    p.add_argument("--batch-size", type=int, default=given.limits.batch)
    p.add_argument("--top-k", type=int, default=given.limits.top_k)
    p.add_argument("--max-tokens", type=int, default=given.limits.token_ceiling)
    p.add_argument("--no-cascade", action="store_true", default=not given.cascade)
    p.add_argument("--no-reflection", action="store_true", default=not given.reflection)
    p.add_argument("--review-only", action="store_true", help="show mappings below the medium band only")
    p.add_argument("--quiet", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    try:
        given = settings.load()
    except ValueError as e:
        print(f"error: a setting can't be read: {e}", file=sys.stderr)
        return 2
    args = parser(given).parse_args(argv)
    spark = SparkSession.builder.appName("docweave").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    limits = replace(given.limits, batch=args.batch_size, top_k=args.top_k, token_ceiling=args.max_tokens)
    try:
        source, dest = reader.read_source(spark, args.source), reader.read_dest(spark, args.dest)
        more: dict = {"pack": read_pack(spark, args.knowledge) if args.knowledge else default_pack()}
        spent = None
        if args.records:
            records = calls.read_records(spark, args.records)
            spent = calls.calls_of(records)
            check_budget(spent, 0, limits.token_ceiling)
            answers = Replay(calls.answers_of(records, args.strong_model), strict=False)
            more |= {"cheap": answers, "routes": calls.routes_of(records), "strong": None if args.no_cascade else answers}
        result = map_schemas(source, dest, limits=limits, reflection=not args.no_reflection, **more)
    except (SchemaError, LookupError, BudgetExceeded) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    if args.output:
        folder = args.output.rstrip("/")
        writers.write_text(spark, f"{folder}/{writers.mapping_name(result.document)}", writers.mapping_text(result.document))
        for name, frame in result.report().items():
            writers.write_json(frame, f"{folder}/report/{name}")
        if spent is not None:
            prices = model_prices(spark)
            own = priced(spent, prices)
            for name, frame in {"totals": totals(own), "by_stage": by_stage(own), "what_if": what_if(totals(own), prices)}.items():
                writers.write_json(frame, f"{folder}/cost/{name}")
    if args.trace:
        writers.write_json(result.log.trace(spark), args.trace)
    if args.runs:
        writers.persist_run(result, args.runs)
    if not args.quiet:
        review_list(result.document, limits.medium if args.review_only else None).show(200, truncate=60)
        result.report()["quality"].show()
        result.diagnostics.show(50, truncate=80)
    return 0 if result.ok else 1


if __name__ == "__main__":
    sys.exit(main())
