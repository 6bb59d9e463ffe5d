"""Command line: ``python -m lodestar.plans.cli --root DIR COMMAND ...``."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.summarize import HttpSummarizer
from lodestar.operators.threads import cards, conversation_documents, turn_documents, write_cards
from lodestar.plans.engine import Engine, Namespace, NamespaceNotFound, WriteConflict
from lodestar.plans.http_api import make_server, results
from lodestar.plans.render import plural, render_results, render_rows
from lodestar.session import local_session
from lodestar.sources import exports, files
from lodestar.sources.ndjson import parse_lines, read_ndjson

READERS = {
    "chatgpt": exports.read_chatgpt, "claude": exports.read_claude, "claude-code": exports.read_claude_code, "codex": exports.read_codex,
}


EXPORTS = {"chatgpt": exports.CHATGPT, "claude": exports.CLAUDE}


def _warn_of_bad(spark: SparkSession, path: str, schema: str, base: str = "conversations.json") -> None:
    bad = exports.export_elements(spark, path, schema, base).where(F.col("error").isNotNull()).count()
    if bad:
        print(f"warning: {path}: {bad} elements of {base} could not be read and were skipped", file=sys.stderr)


def import_documents(spark: SparkSession, path: str, kind: str | None = None, per: str = "turn") -> DataFrame:
    """``id, text, attrs`` of whatever lies at ``path``: an export, transcripts
    or text files; a document per turn or per conversation."""
    kind = kind or ("ndjson" if path == "-" or path.endswith((".ndjson", ".jsonl")) and os.path.isfile(path) and files.detect(path) == "files" else files.detect(path))
    if kind == "ndjson":
        return _good_lines(_standard_input(spark) if path == "-" else read_ndjson(spark, path), path)
    if kind == "files":
        return files.file_documents(spark, path)
    if kind in EXPORTS:
        _warn_of_bad(spark, path, EXPORTS[kind])
    more = _project_documents(spark, path) if kind == "claude" else None
    docs = _conversations(READERS[kind](spark, path), per)
    return docs if more is None else docs.unionByName(more)


def _standard_input(spark: SparkSession) -> DataFrame:
    """Lines of the standard input with their numbers."""
    rows = [(n, line.rstrip("\n")) for n, line in enumerate(sys.stdin, 1)]
    return parse_lines(spark.createDataFrame(rows, "line int, value string")).drop("value")


def _good_lines(lines: DataFrame, path: str) -> DataFrame:
    """Documents; the bad lines are reported (the first few each) and counted."""
    bad = lines.where(F.col("error").isNotNull())
    n = bad.count()
    if n:
        for r in bad.limit(20).collect():
            place = f"line {r['line']}" if "line" in lines.columns else "a line"
            print(f"warning: {path}: {place}: {r['error']}", file=sys.stderr)
        print(f"warning: {path}: {plural(n, 'line')} skipped", file=sys.stderr)
    return lines.where(F.col("error").isNull()).select("id", "text", "attrs")


def seed_documents(spark: SparkSession, path: str) -> DataFrame:
    """Text files as documents with ``path, name, modified, size``; unlike an
    import, a path that cannot be read is an error, and nothing is guessed."""
    if not os.path.exists(path):
        raise ValueError(f"{path} does not exist")
    if os.path.isdir(path):
        for folder, _, names in os.walk(path, onerror=_raise):
            for name in names:
                with open(os.path.join(folder, name), "rb"):
                    pass
    docs = files.file_documents(spark, path)
    keep = [F.get_json_object("attrs", f"$.{k}").alias(k) for k in ("modified", "name", "path")]
    attrs = F.to_json(F.struct(*keep, F.get_json_object("attrs", "$.size").cast("bigint").alias("size")))
    return docs.select("id", "text", attrs.alias("attrs"))


def _raise(error: OSError) -> None:
    raise ValueError(str(error))


def card_rows(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Cards of the conversations at ``path``, summarised by the service that the
    environment names, if any."""
    kind = kind or files.detect(path)
    if kind not in READERS:
        raise ValueError(f"{path} holds no conversations")
    return cards(READERS[kind](spark, path), service=HttpSummarizer.from_environment())


def _project_documents(spark: SparkSession, path: str) -> DataFrame | None:
    """The project files beside the conversations of an export, if any."""
    if not os.path.exists(path) or files.shallowest(files.names_in(path), "projects.json") is None:
        return None
    _warn_of_bad(spark, path, exports.CLAUDE_PROJECTS, "projects.json")
    p = exports.read_claude_projects(spark, path)
    created = F.when(F.col("created") != "", F.col("created")).alias("created")
    attrs = F.struct(created, F.lit("project_doc").alias("kind"), "name", "project", "session", F.lit("claude").alias("source"))
    return p.select("id", "text", F.to_json(attrs).alias("attrs"))


def _conversations(turns: DataFrame, per: str) -> DataFrame:
    if per == "turn":
        return turn_documents(turns)
    return conversation_documents(turns).select("id", "text", "attrs")


def _open(engine: Engine, name: str) -> Namespace:
    try:
        return engine.namespace(name)
    except NamespaceNotFound:
        return engine.create_namespace(name)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestar")
    p.add_argument("--root", default=os.environ.get("LODESTAR_ROOT", "lodestar-data"))
    p.add_argument("--ns", default=os.environ.get("LODESTAR_NS", "default"))
    p.add_argument("--json", action="store_true", help="answer in JSON")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("add", help="import an export, transcripts, NDJSON or text files")
    c.add_argument("path", nargs="+")
    c.add_argument("--format", choices=[*READERS, "files", "ndjson"])
    c.add_argument("--per", choices=["turn", "conversation"], default="turn")
    c.add_argument("--cards", metavar="DIR", help="also write a card per conversation")
    c = sub.add_parser("seed", help="add text files, every one of which must be readable")
    c.add_argument("path", nargs="+")
    c = sub.add_parser("search", help="search a namespace")
    c.add_argument("text", nargs="+")
    c.add_argument("-k", type=int, default=1)
    c.add_argument("--where", default="")
    c.add_argument("--mode", default="hybrid")
    c = sub.add_parser("ls", help="list groups or documents")
    c.add_argument("source", nargs="?")
    c.add_argument("--by", default="session")
    c.add_argument("--docs", action="store_true")
    c.add_argument("--where", default="")
    c.add_argument("-n", type=int, default=25)
    c.add_argument("--offset", type=int, default=0)
    c.add_argument("--sort", default="created")
    c.add_argument("--asc", action="store_true")
    c = sub.add_parser("rm", help="delete documents by id")
    c.add_argument("ids", nargs="+")
    c = sub.add_parser("ns", help="list, create or drop namespaces")
    c.add_argument("action", choices=["list", "create", "rm"])
    c.add_argument("name", nargs="?")
    c = sub.add_parser("serve", help="serve over HTTP")
    c.add_argument("--port", type=int, default=8080)
    return p


def run(args: argparse.Namespace, engine: Engine) -> object:
    """The command's answer, ready for JSON."""
    if args.command in ("add", "seed"):
        ns = _open(engine, args.ns)
        total = dict.fromkeys(("written", "skipped", "chunks"), 0)
        for p in args.path:
            docs = seed_documents(engine.spark, p) if args.command == "seed" else import_documents(engine.spark, p, args.format, args.per)
            done = ns.write(docs)
            total = {k: v + getattr(done, k) for k, v in total.items()}
            print(f"{p}: {plural(done.written, 'document')} written, {done.skipped} unchanged", file=sys.stderr)
            if getattr(args, "cards", None):
                total["cards"] = total.get("cards", 0) + write_cards(card_rows(engine.spark, p, args.format), args.cards)["written"]
        return total
    if args.command == "search":
        return results(engine.namespace(args.ns).query(" ".join(args.text), args.where or None, args.mode, args.k))
    if args.command == "ls":
        where = ",".join(x for x in (args.where, f"source={args.source}" if args.source else "") if x)
        page = {"limit": args.n or -1, "offset": args.offset, "sort": args.sort, "ascending": args.asc}
        ns = engine.namespace(args.ns)
        rows = ns.list(where, **page) if args.docs else ns.groups(args.by, where, **page)
        total = ns.count(where) if args.docs else ns.count_groups(args.by, where)
        # a page, or with -n 0 all rows, of which each is handed on as it comes
        return {"rows": [r.asDict() for r in rows.toLocalIterator()], "total": total}
    if args.command == "rm":
        if len(args.ids) == 1 and engine.exists(f"{engine.root}/{args.ids[0]}/_CONFIG"):
            raise ValueError(f"{args.ids[0]!r} is a namespace: rm deletes documents by id, ns rm drops a namespace")
        return {"deleted": engine.namespace(args.ns).delete(args.ids)}
    if args.command == "ns":
        if args.action == "list":
            return [r.asDict() for r in engine.list_namespaces().collect()]
        (engine.create_namespace if args.action == "create" else engine.drop_namespace)(args.name or args.ns)
        return {"namespace": args.name or args.ns, "action": args.action}
    server = make_server(engine, args.port)
    print(f"listening on port {server.server_address[1]}", flush=True)
    server.serve_forever()
    return None


def as_text(args: argparse.Namespace, answer: object) -> str:
    """The answer as it is printed."""
    if not args.json and args.command == "search":
        return render_results(answer)
    if not args.json and args.command == "ls":
        return render_rows(answer["rows"], answer["total"], "document" if args.docs else args.by, args.offset)
    return json.dumps(answer, indent=2, ensure_ascii=False)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    engine = Engine(local_session(app="lodestar"), args.root)
    try:
        print(as_text(args, run(args, engine)))
    except (NamespaceNotFound, ValueError, LookupError, WriteConflict) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
