"""The command line: a thin layer over Index and Engine.

    python -m textloom "query" ["query" ...] [FOLDER]     search (the default command)
    python -m textloom index|status|ls|sweep|remove|clear|compact|watch|eval|config|include|exclude|version|db-path

Exit codes: 0 done, 1 not found or not available, 2 wrong use or an error, 130 interrupted.
"""

from __future__ import annotations

import argparse
import json
import sys
import time
from pathlib import Path

from textloom.config import SearchConfig, load_config, save_config

VERSION = "0.2"
COMMANDS = "search index status ls sweep remove clear compact watch eval config include exclude version db-path".split()


def human_size(n: float) -> str:
    for unit in ("B", "KB", "MB", "GB"):
        if n < 1024:
            return f"{n:.0f} {unit}" if unit == "B" else f"{n:.1f} {unit}"
        n /= 1024
    return f"{n:.1f} TB"


def ago(then: float | None, now: float) -> str:
    if not then:
        return "never"
    s = max(0, int(now - then))
    for size, unit in ((86400, "d"), (3600, "h"), (60, "m")):
        if s >= size:
            return f"{s // size}{unit} ago"
    return "just now"


def shown_path(path: str, base: str) -> str:
    base = base.rstrip("/") + "/"
    return path.removeprefix(base)


def arguments(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="textloom")
    sub = p.add_subparsers(dest="command", required=True)
    add = lambda name: sub.add_parser(name)
    s = add("search")
    s.add_argument("queries", nargs="*")
    s.add_argument("-p", "--path")
    s.add_argument("-Q", "--query-file")
    s.add_argument("-k", "--limit", type=int, default=10)
    s.add_argument("--mode", choices=("full", "bm25", "embedding", "hybrid"), default="full")
    s.add_argument("--json", action="store_true")
    s.add_argument("--no-index", action="store_true")
    s.add_argument("--ext", action="append", default=[])
    s.add_argument("--not-ext", action="append", default=[])
    s.add_argument("--without", action="append", default=[], help="drop hits whose snippet matches")
    for name in ("index", "ls", "sweep", "watch", "eval"):
        add(name).add_argument("path", nargs="?", default=".")
    sub.choices["sweep"].add_argument("--retention-days", type=float, default=30)
    w = sub.choices["watch"]
    w.add_argument("--debounce", type=float, default=2)
    w.add_argument("--every", type=float, default=10)
    w.add_argument("--exclude", action="append", default=[])
    w.add_argument("--max-depth", type=int)
    w.add_argument("--no-initial-index", action="store_true")
    w.add_argument("--startup-delay", type=float, default=0)
    w.add_argument("--passes", type=int, help="stop after so many passes")
    sub.choices["eval"].add_argument("--mode", action="append", choices=("bm25", "embedding", "hybrid"))
    add("remove").add_argument("paths", nargs="+")
    for name in ("status", "clear", "compact", "version", "db-path"):
        add(name)
    c = add("config")
    c.add_argument("key", nargs="?")
    c.add_argument("value", nargs="?")
    for name in ("include", "exclude"):
        e = add(name)
        e.add_argument("action", choices=("add", "remove", "list", "clear"))
        e.add_argument("values", nargs="*")
    return p.parse_args(argv)


def resolved(queries: list[str], path: str | None) -> tuple[str, list[str]]:
    """(folder or file, queries): an explicit path, or the last of several arguments that exists, or here."""
    if not path and len(queries) > 1 and Path(queries[-1]).expanduser().exists():
        *queries, path = queries
    return str(Path(path or ".").expanduser().resolve()), queries


def edit_list(settings: dict, key: str, action: str, values: list[str]) -> int:
    held = settings[key]
    if action == "list":
        print("\n".join(held))
        return 0
    if action != "clear" and not values:
        print("nothing named", file=sys.stderr)
        return 2
    gone = [v for v in values if v not in held] if action == "remove" else []
    settings[key] = [] if action == "clear" else [*held, *(v for v in values if v not in held)] if action == "add" else [v for v in held if v not in values]
    save_config(settings)
    for v in gone:
        print(f"not in the list: {v}", file=sys.stderr)
    return 1 if gone else 0


def session():
    from pyspark.sql import SparkSession

    from textloom.session import ensure_importable

    spark = SparkSession.getActiveSession() or SparkSession.builder.appName("textloom").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    return ensure_importable(spark)


def open_index(spark, root: str):
    from pyspark.errors import AnalysisException

    from textloom.operators.store import Index

    index = Index(spark, root)
    try:
        index._state()
    except AnalysisException:
        index.create()
    return index


def contents(spark, folder: str, settings: dict):
    """(path, size, mtime, text) of a folder's files, or of one file."""
    from pyspark.sql import functions as F

    from textloom.sources.extract import extract_text
    from textloom.sources.files import read_files

    base = folder if Path(folder).is_dir() else str(Path(folder).parent)
    files = read_files(spark, base, include=settings["include"], exclude=settings["exclude"])
    files = files if base == folder else files.filter(F.col("path") == folder)
    return extract_text(files).select("path", "size", "mtime", "text")


def search(spark, args, settings: dict, root: str) -> int:
    from textloom.plans.search import Engine, hits_json
    from textloom.sources.datasets import query_file, query_lines

    folder, words = resolved(args.queries, args.path)
    if args.query_file:
        queries = query_file(spark, args.query_file)
    else:
        queries = query_lines(spark.createDataFrame([(i, q.strip()) for i, q in enumerate(words)], "at long, text string"))
    asked = {r.query_id: r.text for r in queries.collect()}  # typed by hand
    if not asked:
        print("no query", file=sys.stderr)
        return 2
    index = open_index(spark, root)
    if not args.no_index:
        index.refresh(contents(spark, folder, settings))
    config = SearchConfig(**(settings["search"] | {}))
    engine = Engine.of(index, config=config)
    if args.mode == "full":
        hits = engine.search(queries, folder, args.ext, args.not_ext, args.without, args.limit)
    else:
        from pyspark.sql import functions as F

        hits = engine.rank(queries, args.mode, args.limit).join(engine.scoped(folder, args.ext, args.not_ext).select("doc_id", "path", F.left("text", F.lit(config.snippet_chars)).alias("snippet")), "doc_id").withColumn("rank_stage", F.lit(args.mode))
    if args.json:
        found = {r.query_id: json.loads(r.payload) for r in hits_json(hits).collect()}
        print(json.dumps([{"query": q, "hits": found.get(i, [])} for i, q in sorted(asked.items())], ensure_ascii=False))
        return 0
    rows = hits.orderBy("query_id", "rank").collect()  # as many as were asked for
    for i, q in sorted(asked.items()):
        print(f"# {q}")
        files: dict[str, list] = {}
        for r in rows:
            if r.query_id == i:
                files.setdefault(r.path, []).append(r)
        for path, of in files.items():
            print(shown_path(path, folder))
            for r in of:
                print(f"  {r.score:.4f}  {' '.join(r.snippet.split())}")
        if not files:
            print("  nothing found")
    return 0


def evaluate(spark, args) -> int:
    """Scores of the modes on a collection folder (corpus.jsonl, queries.jsonl, qrels/test.tsv)."""
    from textloom.functions.embed import HashingEmbedder
    from textloom.operators.evaluate import report
    from textloom.plans.search import Engine
    from textloom.sources.datasets import collection

    if not (Path(args.path) / "corpus.jsonl").exists():
        print(f"no corpus.jsonl in {args.path}", file=sys.stderr)
        return 1
    docs, queries, rel = collection(spark, args.path)
    e = HashingEmbedder()
    vectors = e.embed(docs).filter("v is not null").select("doc_id", "v")
    queries = e.embed(queries).withColumnRenamed("v", "qv")
    engine = Engine(docs, vectors)
    report({m: engine.rank(queries, m) for m in args.mode or ("bm25", "embedding", "hybrid")}, rel).show(truncate=False)
    return 0


def watch(spark, args, settings: dict, root: str) -> int:
    """Passes over a folder, as long as there are changes to index; a pass waits until the folder has been
    quiet for --debounce seconds, and passes lie --every seconds apart. Each 3600 seconds a sweep."""
    from pyspark.sql import functions as F

    from textloom.sources.files import ignored, list_files

    folder = str(Path(args.path).expanduser().resolve())
    index, own = open_index(spark, root), settings | {"exclude": [*settings["exclude"], *args.exclude]}
    time.sleep(args.startup_delay)
    if not args.no_initial_index:
        index.refresh(contents(spark, folder, own))
    seen, swept, done = None, time.time(), 0
    while args.passes is None or done < args.passes:
        listing = list_files(spark, folder, include=own["include"], exclude=own["exclude"])
        listing = listing.filter(~ignored(F.col("path"), own["exclude"], args.max_depth, folder + "/"))
        now = listing.agg(F.count("*"), F.sum(F.xxhash64("path", "size", "mtime").cast("decimal(38,0)"))).first()
        if seen is not None and now == seen:
            index.refresh(contents(spark, folder, own).join(listing.select("path"), "path", "left_semi"))
            lost = index.under(folder).join(listing.select("path"), "path", "left_anti").select("path")
            if not lost.isEmpty():
                index.remove(lost)
            done += 1
            time.sleep(args.every if args.passes is None or done < args.passes else 0)
        else:
            time.sleep(args.debounce)
        seen = now
        if time.time() - swept > 3600:
            index.sweep(index.files().select("path").join(listing.select("path"), "path", "left_semi"), retention_days=180)
            swept = time.time()
    return 0


def run(args: argparse.Namespace) -> int:
    settings = load_config()
    root = settings["index"] or f"file://{Path.home()}/.textloom/index"
    if args.command == "version":
        print(VERSION)
        return 0
    if args.command == "db-path":
        print(root)
        return 0
    if args.command in ("include", "exclude"):
        return edit_list(settings, args.command, args.action, args.values)
    if args.command == "config":
        if args.key is None:
            print(json.dumps(settings, indent=2, sort_keys=True))
            return 0
        at, key = (settings, args.key) if args.key in settings else (settings["search"], args.key)
        if key not in at:
            print(f"no setting {key}", file=sys.stderr)
            return 1
        if args.value is None:
            print(json.dumps(at[key]))
            return 0
        at[key] = args.value if isinstance(at[key], str) else type(at[key])(json.loads(args.value))
        save_config(settings)
        return 0
    spark = session()
    if args.command == "search":
        return search(spark, args, settings, root)
    if args.command == "eval":
        return evaluate(spark, args)
    if args.command == "watch":
        return watch(spark, args, settings, root)
    from pyspark.sql import functions as F

    index = open_index(spark, root)
    if args.command == "index":
        index.refresh(contents(spark, resolved([], args.path)[0], settings))
    elif args.command == "sweep":
        from textloom.sources.files import list_files

        folder = resolved([], args.path)[0]
        there = list_files(spark, folder, include=settings["include"], exclude=settings["exclude"]).select("path")
        elsewhere = index.files().filter(~F.col("path").startswith(folder + "/")).select("path")
        index.sweep(there.unionByName(elsewhere), retention_days=args.retention_days)
    elif args.command == "remove":
        index.remove(spark.createDataFrame([(str(Path(p).expanduser().resolve()),) for p in args.paths], "path string"))
    elif args.command == "clear":
        index.clear()
    elif args.command == "compact":
        index.compact()
    if args.command == "ls":
        for r in index.under(resolved([], args.path)[0]).orderBy("path").toLocalIterator():
            print(f"{human_size(r['size']):>10}  {ago(r.indexed_at, time.time()):>10}  {r.path}")
        return 0
    s = index.status().first()
    print(f"files {s.files}, chunks {s.chunks}, vectors {s.vectors}, indexed {ago(s.last_indexed, time.time())}")
    return 0


def main(argv: list[str] | None = None) -> int:
    argv = list(sys.argv[1:] if argv is None else argv)
    if argv and argv[0] not in (*COMMANDS, "-h", "--help"):
        argv.insert(0, "search")
    try:
        return run(arguments(argv))
    except SystemExit as e:
        return e.code if isinstance(e.code, int) else 2
    except KeyboardInterrupt:
        return 130
    except Exception as e:  # one line for the user
        print(f"{type(e).__name__}: {e}".splitlines()[0], file=sys.stderr)
        return 2
