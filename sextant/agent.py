"""A bounded loop that answers questions about code from facts and search, one tool at a time."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.functions import text as T
from sextant.operators import code
from sextant.runtime import cut

MOST_STEPS, ENOUGH = 6, 5


@dataclass
class Step:
    number: int
    tool: str
    argument: str
    reason: str
    results: list = field(default_factory=list)
    seconds: float = 0.0
    note: str = ""


class CodeAgent:
    """Answers from structural facts, and from a search function where structure does not help."""

    def __init__(self, spark: SparkSession, files: DataFrame, search=None, k: int = 5, most: int = MOST_STEPS):
        self.spark, self.search, self.k, self.most = spark, search, k, most
        self.texts = files
        self.facts = {n: cut(f) for n, f in code.structural_facts(files).items()}
        self.edges = cut(code.call_edges(self.facts["defs"], self.facts["calls"], self.facts["imports"]))

    def plan(self, question: str) -> list[tuple[str, str, str]]:
        """(tool, argument, reason) to try in order. A question about order carries both names, parted by a blank."""
        q = F.col("q")
        row = self.spark.createDataFrame([(question,)], "q string").select(T.structural_intent(q).alias("intent"), T.subject_of(q).alias("subject"), T.subject_pair(q).alias("pair")).first()
        if row["intent"] == "call_order":
            steps = [("call_order", f"{row['pair']['first']} {row['pair']['second']}", "the question is about order")] if row["pair"] else []
        else:
            steps = [(row["intent"], row["subject"], "the question is structural")] if row["intent"] and row["subject"] else []
        if row["subject"]:
            steps.append(("find_definitions", row["subject"], "where the subject is defined"))
        return [*steps, ("search", question, "similar code")]

    def refine(self, tool: str, argument: str, found: list[dict]) -> list[tuple[str, str, str]]:
        """What to do after a step: the last part of a dotted name that was not found, and the text of one definition that was."""
        if not found and tool not in ("search", "call_order", "read") and "." in argument:
            return [(tool, argument.rsplit(".", 1)[1], "nothing under the full name")]
        if tool == "find_definitions" and len(found) == 1:
            d = found[0]
            return [("read", f"{d['file']}:{d['start_line']}-{d['end_line']}", "the definition is the only one")]
        return []

    def _read(self, place: str) -> list[dict]:
        """The lines `file:first-last`."""
        file, _, span = place.rpartition(":")
        first, last = map(int, span.split("-"))
        texts = self.texts.where(F.col("file") == file).select("text").limit(1).collect()
        return [{"file": file, "start_line": first, "end_line": last, "text": "\n".join((t["text"] or "").split("\n")[first - 1 : last])} for t in texts]

    def _run(self, tool: str, argument: str) -> list[dict]:
        f = self.facts
        if tool == "search":
            return [r.asDict() for r in self.search(argument).limit(self.k).collect()] if self.search else []
        if tool == "read":
            return self._read(argument)
        frame = {
            "call_order": lambda: code.calls_in_order(f["calls"], *argument.split(" ", 1)),
            "who_calls": lambda: code.who_calls(self.edges, argument),
            "what_calls": lambda: code.what_calls(self.edges, argument),
            "where_imported": lambda: code.where_imported(f["imports"], argument),
            "where_used": lambda: code.where_used(f["names"], f["strings"], argument),
            "find_definitions": lambda: code.find_definitions(f["defs"], argument),
        }[tool]()
        return [r.asDict() for r in frame.limit(2 * self.k).collect()]

    def run(self, question: str) -> dict:
        """Evidence and steps; a step that was taken before is refused, and enough evidence ends the loop."""
        steps, evidence, done = [], [], set()
        todo = self.plan(question)
        while todo:
            tool, argument, reason = todo.pop(0)
            if len(steps) >= self.most or len(evidence) >= ENOUGH:
                break
            if (tool, argument) in done:
                continue
            done.add((tool, argument))
            start = time.time()
            found = self._run(tool, argument)
            steps.append(Step(len(steps) + 1, tool, argument, reason, found[:10], time.time() - start))
            evidence += [{"tool": tool} | r for r in found]
            todo = self.refine(tool, argument, found) + todo
        return {"question": question, "steps": steps, "answers": evidence[:20]}
