"""Command line: seed, ask, eval, ablation, build, check, warehouse, publish, verify, summary and serve."""

from __future__ import annotations

import argparse
import json

from .operators import retrieval
from .operators.marginals import matched_period
from .plans import ablation, evaluation, mart, service
from .plans.ask import ask, draft_note
from .session import build_session
from .sources.files import Files
from .sources.registrations import RegistrationStore
from .sources.snapshots import SnapshotStore, read_tsv, validated, write_tsv


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="python -m tallyforge", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("seed", "ablation", "eval"):
        part = commands.add_parser(name)
        part.add_argument("--mart", required=True, help="folder of the mart's tables")
        if name != "seed":
            part.add_argument("--check", metavar="FILE", help="a saved result: exit 1 if this one differs")
        if name == "eval":
            part.add_argument("--questions", required=True, help="JSON: cases, and retrieval_cases")
    question = commands.add_parser("ask")
    question.add_argument("question")
    question.add_argument("--mart", required=True)
    question.add_argument("--docs", help="Markdown files whose sections can answer questions about definitions")
    question.add_argument("--draft", action="store_true", help="a note to be confirmed by a person")
    question.add_argument("--force", action="store_true", help="guess instead of stopping")
    for name in ("build", "check", "warehouse"):
        part = commands.add_parser(name)
        part.add_argument("--years", type=int, nargs="+", required=True)
        for folder in ("raw", "curated", "artifacts"):
            part.add_argument(f"--{folder}-dir", required=True)
        part.add_argument("--data-asof", default="2026-08-31")
        part.add_argument("--sources", metavar="FILE", help="JSON that names the reviewed years and their files; other years are refused")
        if name == "build":
            part.add_argument("--refresh", action="store_true", help="build again what hasn't changed")
            part.add_argument("--failure-after-rows", type=int, help="for tests: fail at a row beyond this number")
        part.add_argument("--out", help="warehouse: folder for the aggregates as TSV")
        part.add_argument("--runs", help="warehouse: folder in which each run is kept under its own id")
    part = commands.add_parser("publish")
    part.add_argument("--aggregates", help="aggregates as TSV")
    part.add_argument("--run", help="a kept warehouse run, which must have passed")
    part.add_argument("--version", help="needed with --aggregates; else the run's id")
    part.add_argument("--store", required=True)
    commands.add_parser("verify", help="serving answers of the active snapshot against sums of its families").add_argument("--store", required=True)
    commands.add_parser("summary", help="matched-period summary of saved aggregates").add_argument("--aggregates", required=True)
    part = commands.add_parser("serve")
    part.add_argument("--store", required=True)
    part.add_argument("--port", type=int, default=8765)
    part.add_argument("--mart", help="folder of the mart's tables: adds the pages /ask and /desk")
    return parser


def main(argv: list[str] | None = None) -> None:
    args = _parser().parse_args(argv)
    spark = build_session()
    show = lambda value: print(json.dumps(value, ensure_ascii=False, indent=2, default=str))


    def checked(result) -> None:
        """Shows a result; with --check its differences from a saved one, and exit 1 if there are any."""
        result = json.loads(json.dumps(result, ensure_ascii=False, default=str))
        if args.check is None:
            return show(result)
        saved = Files(spark).read_json(args.check)
        found = ["no saved result"] if saved is None else evaluation.differences(saved, result)
        show({"differences": found})
        if found:
            raise SystemExit(1)

    def reviewed(path: str | None) -> dict | None:
        found = Files(spark).read_json(path) if path else None
        if path and (found is None or not isinstance(found.get("files"), dict)):
            raise SystemExit(f"{path} names no reviewed files")
        return found

    if args.command in ("seed", "ask", "ablation", "eval"):
        star = mart.star(spark, args.mart)
        if args.command == "seed":
            show({"fact_rows": star.fact.count()})
        elif args.command == "ablation":
            checked({"metric_flip": ablation.metric_flip(star), "lambda": [r.asDict() for r in ablation.lambda_sweep(spark).collect()]})
        elif args.command == "eval":
            cases = Files(spark).read_json(args.questions)
            checked(evaluation.evaluate(spark, star, cases["cases"], cases.get("retrieval_cases", [])))
        else:
            result = ask(spark, star, args.question, args.force, retrieval.sections(spark, args.docs) if args.docs else None)
            show(draft_note(args.question, result) if args.draft else {k: v for k, v in result.items() if k != "frame"})
    elif args.command in ("build", "check", "warehouse"):
        store = RegistrationStore(spark, args.raw_dir, args.curated_dir, args.artifacts_dir, args.data_asof, reviewed(args.sources))
        if args.command == "warehouse":
            result = store.run_warehouse(args.years, args.runs)
            found = result.pop("marginals")
            if args.out and result["passed"]:
                write_tsv(found, args.out)
            show(result)
        elif args.command == "build":
            show(store.build(args.years, refresh=args.refresh, failure_after_rows=args.failure_after_rows))
        else:
            show(store.check(args.years))
    elif args.command == "publish":
        store = SnapshotStore(spark, args.store)
        if bool(args.run) == bool(args.aggregates) or (args.aggregates and not args.version):
            raise SystemExit("publish takes --run, or --aggregates with --version")
        show(store.publish_run(args.run, args.version) if args.run else store.publish(args.version, read_tsv(spark, args.aggregates)))
    elif args.command == "verify":
        found = SnapshotStore(spark, args.store).active()
        if found is None:
            raise SystemExit("NO_ACTIVE_DATASET")
        show({"version": found[0]["version"], "compared": evaluation.verify_serving(found[1])})
    elif args.command == "summary":
        show(matched_period(validated(read_tsv(spark, args.aggregates))))
    else:
        desk = service.Desk(spark, mart.star(spark, args.mart)) if args.mart else None
        service.server(SnapshotStore(spark, args.store), args.port, desk).serve_forever()


if __name__ == "__main__":
    main()
