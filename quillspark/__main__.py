"""python -m quillspark ROOT [steps]: --reset, --path FOLDER, --file FILE [--supersedes NUMBER], --rechunk, --reembed, --status,
--ask TEXT, --eval FILE [--k N] [--out FOLDER], --beir FOLDER [--subset N]: steps run in this order."""

from __future__ import annotations

import argparse
from pathlib import Path

from quillspark.engine import Engine
from quillspark.operators import answers as A
from quillspark.operators import evaluation as E
from quillspark.session import build_session
from quillspark.sources import files


def evaluate(engine: Engine, path: str, k: int, out: str) -> str:
    """Modes and chunkers over the judged queries of a JSON file; tables and reports go to out, the report is returned."""
    judged = files.read_judged_queries(engine.spark, path)
    queries, docs = judged.select("qid", "text").distinct(), engine._docs()
    qrels, missing = E.resolve_judgments(judged, docs)
    modes = E.write_results(engine.spark, E.mode_sweep(queries, docs.select("chunk_id", "text", "status"), qrels, k), out, "modes")
    sweep = E.markdown(engine.sweep(judged, queries, k))
    answers = engine.ask(queries).select("qid", "rate", "uncited", "invalid")
    report = "\n\n".join(["# Evaluation", f"k = {k}; {missing.count()} judgments without a chunk", "## Modes", modes, "## Chunkers", sweep, "## Faithfulness", str(A.faithfulness_summary(answers).first().asDict())])
    Path(out, "report.md").write_text(report)
    return report


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="quillspark", description=__doc__)
    p.add_argument("root")
    for flag in ("--reset", "--rechunk", "--reembed", "--status"):
        p.add_argument(flag, action="store_true")
    for option in ("--path", "--file", "--supersedes", "--ask", "--eval", "--beir"):
        p.add_argument(option)
    p.add_argument("--chunker", default="structure_aware")
    p.add_argument("--out", default="results")
    p.add_argument("--k", type=int, default=5)
    p.add_argument("--subset", type=int, default=200)
    a = p.parse_args(args)
    engine = Engine(build_session(), a.root, a.chunker)
    if a.reset:
        engine.reset()
    if a.path:
        engine.ingest_folder(a.path).show(truncate=60)
    if a.file:
        engine.upload(Path(a.file).read_bytes(), a.file, target=a.supersedes).show(truncate=60)
    if a.rechunk:
        engine.rebuild(a.chunker)
    if a.reembed:
        print(engine.reembed().count(), "chunks embedded by", engine.embedder.signature)
    if a.status:
        for d in engine.documents().toLocalIterator():
            print(d["doc_number"], d["title"])
            for v in d["versions"]:
                print("   ", v["version_number"], v["status"], v["published_date"], f"chunks {v['chunks']}, active {v['active']}", v["superseded_by"] or "")
        engine.stats().show()
    if a.ask:
        engine.ask(engine.spark.createDataFrame([("1", a.ask)], "qid string, text string")).show(truncate=False)
    if a.eval:
        print(evaluate(engine, a.eval, a.k, a.out))
    if a.beir:
        print(E.markdown(E.beir_evaluate(*E.beir_subset(*files.read_beir(engine.spark, a.beir), a.subset), 10)))


if __name__ == "__main__":
    main()
