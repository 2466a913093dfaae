"""Command line: ingest FILE, query TEXT, stats, save PATH, load PATH, interactive."""

from __future__ import annotations

import argparse
from collections.abc import Callable

from .session import session
from .system import MemorySystem


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quern", description="Retrieval memory on Spark")
    p.add_argument("--config", help="YAML file; defaults without it")
    sub = p.add_subparsers(dest="command", required=True)
    ingest = sub.add_parser("ingest", help="add a file")
    ingest.add_argument("file")
    ingest.add_argument("--source", help="name to store instead of the file's")
    query = sub.add_parser("query", help="answer a question")
    query.add_argument("question")
    query.add_argument("--k", type=int, default=3, help="chunks to retrieve")
    query.add_argument("--verbose", action="store_true", help="show the retrieved chunks")
    sub.add_parser("stats", help="show statistics")
    for name in ("save", "load"):
        sub.add_parser(name, help=f"{name} the memory").add_argument("path")
    sub.add_parser("interactive", help="answer questions until exit or quit")
    return p


def show(result: dict, verbose: bool, out: Callable[[str], None]) -> None:
    out("=" * 60 + "\nANSWER:\n" + result["answer"] + "\n" + "=" * 60)
    for i, s in enumerate(result["sources"] if verbose else [], 1):
        meta = s["metadata"]
        out(f"\n[{i}] Source: {meta.get('source', 'Unknown')} (.{meta.get('extension', 'txt')})\n    Type: {meta.get('file_type', 'text')} | Score: {s['score']:.3f}\n{'-' * 40}\n{s['text'][:200]}...")


def main(args: list[str] | None = None, system: MemorySystem | None = None, out: Callable[[str], None] = print, ask: Callable[[str], str] = input) -> int:
    a = parser().parse_args(args)
    system = system or MemorySystem(session(), a.config)
    if a.command == "ingest":
        stats = system.ingest_file(a.file, a.source)
        out(f"Created {stats['chunks_created']} chunks\nStored {stats['embeddings_stored']} embeddings")
    elif a.command == "query":
        show(system.query(a.question, a.k, return_context=True), a.verbose, out)
    elif a.command == "stats":
        out("\n".join(["System Statistics:", *(f"  {k}: {v}" for k, v in system.statistics().items())]))
    elif a.command == "save":
        system.save_memory(a.path)
        out(f"Memory saved to {a.path}")
    elif a.command == "load":
        system.load_memory(a.path)
        out(f"Memory loaded from {a.path}")
    else:
        while (question := ask("\nYour question: ")).lower() not in ("exit", "quit"):
            out(f"\n{system.query(question)['answer']}\n")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
