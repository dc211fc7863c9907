"""Control loops. They hold the small state of one session on the driver; all data stays in DataFrames."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from contextlib import suppress
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.lm import Provider

#: Rows of a result that a session shows to the model; a final answer is given out whole.
SHOWN_ROWS = 20
#: Sub-questions of one block that run at a time.
SUB_THREADS = 4


class LimitReached(RuntimeError):
    """A run went beyond a limit; partial is the best answer so far."""

    def __init__(self, what: str, partial: str | None):
        super().__init__(what)
        self.partial = partial


class ErrorLimit(LimitReached):
    """Too many iterations in a row with an error."""


class TokenLimit(LimitReached):
    """More tokens than allowed."""


class CostLimit(LimitReached):
    """More money than allowed."""


class TimeLimit(LimitReached):
    """More seconds than allowed."""


class Cancelled(LimitReached):
    """Stopped by the caller."""


class Session:
    """A persistent namespace of temp views, in which SQL blocks run: context_0, context_1, ... and
    history_0, ...; the names without number are those of number 0."""

    def __init__(self, spark: SparkSession):
        self.spark, self.contexts, self.histories = spark, 0, 0

    def _add(self, kind: str, df: DataFrame, n: int) -> str:
        df.createOrReplaceTempView(f"{kind}_{n}")
        if n == 0:
            df.createOrReplaceTempView(kind)
        return f"{kind}_{n}"

    def add_context(self, payload, n: int | None = None) -> str:
        """A DataFrame, a text, a list of texts or messages, or a dict, as the view context_<n>."""
        n = self.contexts if n is None else n
        self.contexts = max(self.contexts, n + 1)
        if not isinstance(payload, DataFrame):
            rows = payload if isinstance(payload, list) else [payload]
            texts = [(i, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(rows)]
            payload = self.spark.createDataFrame(texts, "ord int, text string")
        return self._add("context", payload, n)

    def add_history(self, messages: list[dict]) -> str:
        rows = [(i, m.get("role"), m.get("content")) for i, m in enumerate(messages)]
        name = self._add("history", self.spark.createDataFrame(rows, "ord int, role string, content string"), self.histories)
        self.histories += 1
        return name

    def run(self, sql: str) -> tuple[str, str]:
        """(output, error) of one block; at most SHOWN_ROWS rows come to the driver."""
        try:
            df = self.spark.sql(sql)
            if m := re.match(r"(?is)\s*create\s+(?:or\s+replace\s+)?(?:global\s+)?temp(?:orary)?\s+view\s+(\w+)", sql):
                return f"view {m[1]} created", ""
            return "\n".join(json.dumps(r.asDict(recursive=True), default=str) for r in df.limit(SHOWN_ROWS).collect()), ""
        except Exception as error:
            return "", str(error).split("\n")[0]

    def value(self, name: str) -> tuple[str | None, str]:
        """(all rows of a view as JSON lines, error): a final answer is not cut. Rows come to the driver partition by
        partition; a result too large for a text is had as a DataFrame by `spark.table`."""
        try:
            return "\n".join(json.dumps(r.asDict(recursive=True), default=str) for r in self.spark.table(name).toLocalIterator()), ""
        except Exception as error:
            return None, str(error).split("\n")[0]

    def variables(self) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables() if t.isTemporary)


_BLOCK = re.compile(r"```(?:repl|sql)\s*\n(.*?)\n```", re.S)
_FINAL = re.compile(r"^\s*FINAL\((.*)\)\s*$", re.M | re.S)
_FINAL_VAR = re.compile(r"^\s*FINAL_VAR\((.*?)\)", re.M | re.S)


@dataclass(frozen=True)
class Limits:
    """None is no limit. compact_at: the share of context_tokens at which the messages are compacted."""

    iterations: int = 30
    depth: int = 1
    errors: int | None = None
    tokens: int | None = None
    cost: float | None = None
    seconds: float | None = None
    compact_at: float | None = None
    context_tokens: int = 128_000


@dataclass
class Spent:
    """What a run has used so far, sub-questions included."""

    tokens: int = 0
    cost: float = 0.0
    began: float = field(default_factory=time.monotonic)

    def seconds(self) -> float:
        return time.monotonic() - self.began


_ASK = re.compile(r"```ask\s*\n(.*?)\n```", re.S)


@dataclass
class Completion:
    """The loop of one question: the model writes SQL blocks, sees their results, and ends with FINAL.

    An ask block holds a sub-question, or a JSON list of them; each runs as a completion of its
    own with what is left of the tokens, the cost and the time, SUB_THREADS at a time, and their
    answers become the view answers_<n>. The errors of a sub-question become its answer. At the
    greatest depth the model is asked directly. A provider may tell its price per token as
    `price`. Hooks: on_subcall(question) and on_subcall_done(question, answer); what they raise is ignored."""

    provider: Provider
    session: Session
    limits: Limits = field(default_factory=Limits)
    depth: int = 0
    on_subcall: Callable[[str], None] | None = None
    on_subcall_done: Callable[[str, str], None] | None = None
    cancelled: Callable[[], bool] = lambda: False
    spent: Spent = field(default_factory=Spent)
    asked: int = 0

    def _complete(self, prompt: str, model: str | None) -> str:
        response = self.provider.complete(prompt, model)
        tokens = -(-(len(prompt) + len(response)) // 4)
        self.spent.tokens += tokens
        self.spent.cost += tokens * getattr(self.provider, "price", 0.0)
        return response

    def _check(self, errors: int, partial: str | None) -> None:
        at = self.limits
        if self.cancelled():
            raise Cancelled("cancelled", partial)
        if at.errors is not None and errors >= at.errors:
            raise ErrorLimit(f"{errors} errors in a row", partial)
        if at.tokens is not None and self.spent.tokens > at.tokens:
            raise TokenLimit(f"{self.spent.tokens} tokens", partial)
        if at.cost is not None and self.spent.cost > at.cost:
            raise CostLimit(f"cost {self.spent.cost:.6f}", partial)
        if at.seconds is not None and self.spent.seconds() > at.seconds:
            raise TimeLimit(f"{self.spent.seconds():.1f} seconds", partial)

    def _compacted(self, messages: list[dict], model: str | None) -> list[dict]:
        """The messages, or the first two with a summary of the others when they fill their share of the context."""
        at = self.limits
        tokens = -(-sum(len(m["content"]) for m in messages) // 4)
        if at.compact_at is None or len(messages) <= 2 or tokens < int(at.compact_at * at.context_tokens):
            return messages
        summary = self._complete("\n".join([m["content"] for m in messages] + ["Summarise the work so far and what is left to do."]), model)
        return [*messages[:2], {"role": "assistant", "content": summary}, {"role": "user", "content": "Continue from the summary above."}]

    def run(self, question: str, model: str | None = None) -> tuple[str, list[dict]]:
        if self.depth >= self.limits.depth:
            return self._complete(question, model), []
        messages = [{"role": "system", "content": f"Views: {', '.join(self.session.variables())}"}, {"role": "user", "content": question}]
        log, errors, partial = [], 0, None
        for n in range(1, self.limits.iterations + 1):
            self._check(errors, partial)
            messages = self._compacted(messages, model)
            partial = response = self._complete("\n".join(m["content"] for m in messages), model)
            blocks, failed = [], False
            for code in _BLOCK.findall(response):
                out, err = self.session.run(code.strip())
                failed |= bool(err)
                blocks.append({"code": code.strip(), "stdout": out, "stderr": err})
            for asked in _ASK.findall(response):
                answers = self.sub_batch(self._questions(asked.strip()), model)
                blocks.append({"code": asked.strip(), "stdout": "\n".join(answers), "stderr": ""})
            log.append({"iteration": n, "response": response, "code_blocks": blocks})
            errors = errors + 1 if failed else 0
            answer = self._answer(response)
            if answer is not None:
                return answer, log
            self._check(errors, partial)
            messages.append({"role": "assistant", "content": response})
            messages += [{"role": "user", "content": f"Code executed:\n{b['code']}\nOutput:\n{b['stdout'] or b['stderr'] or 'No output'}"} for b in blocks]
        return self._complete("\n".join([m["content"] for m in messages] + ["Give your final answer now."]), model), log

    def _answer(self, response: str) -> str | None:
        if m := _FINAL_VAR.search(response):
            name = m[1].strip().strip("\"'")
            return (self.session.value(name)[0] or None) if name.isidentifier() else None
        m = _FINAL.search(response)
        return m[1].strip() if m else None

    @staticmethod
    def _questions(text: str) -> list[str]:
        with suppress(ValueError):
            if isinstance(found := json.loads(text), list):
                return [str(q) for q in found]
        return [text]

    def _left(self) -> Limits:
        """The limits of a sub-question: what is left of the tokens, the cost and the time."""
        at, used = self.limits, self.spent
        less = lambda limit, n: None if limit is None else max(limit - n, 0)
        return replace(at, tokens=less(at.tokens, used.tokens), cost=less(at.cost, used.cost), seconds=less(at.seconds, used.seconds()))

    def sub(self, question: str, model: str | None = None) -> str:
        """A sub-question one level deeper; an error is the answer "Error: ..."."""
        with suppress(Exception):
            self.on_subcall and self.on_subcall(question)
        try:
            child = Completion(self.provider, self.session, self._left(), self.depth + 1, self.on_subcall, self.on_subcall_done, self.cancelled)
            try:
                answer = child.run(question, model)[0]
            finally:
                self.spent.tokens += child.spent.tokens
                self.spent.cost += child.spent.cost
        except Exception as error:
            answer = f"Error: {error}"
        with suppress(Exception):
            self.on_subcall_done and self.on_subcall_done(question, answer)
        return answer

    def sub_batch(self, questions: list[str], model: str | None = None) -> list[str]:
        """The answers in the order of the questions, also as the view answers_<n>; one that fails leaves the others alone."""
        if len(questions) < 2:
            answers = [self.sub(q, model) for q in questions]
        else:
            with ThreadPoolExecutor(min(SUB_THREADS, len(questions))) as pool:
                answers = list(pool.map(lambda q: self.sub(q, model), questions))
        rows = list(zip(range(len(questions)), questions, answers))
        self.session.spark.createDataFrame(rows, "ord int, question string, answer string").createOrReplaceTempView(f"answers_{self.asked}")
        self.asked += 1
        return answers


def first_json(text: str) -> dict:
    """The text as JSON, else the first JSON object in it; none is an error."""
    decoder = json.JSONDecoder()
    for at in [0, *(m.start() for m in re.finditer(r"\{", text))]:
        try:
            found, _ = decoder.raw_decode(text[at:].lstrip())
        except ValueError:
            continue
        if isinstance(found, dict):
            return found
    raise ValueError(f"no JSON object in: {text[:200]}")


@dataclass
class Explorer:
    """The search session of one video: SEARCH, OPEN, SPLIT, MERGE and STOP chosen by a model.

    nodes is the memory, `searched` and `opened` the operators that search it and open a node. The
    frontier keeps its best `cap` items; of a search only as many can enter it, so only they come
    to the driver. Evidence of an opened node and the children of a split one come whole: they
    are bounded by the node. Two OPENs in a row without new evidence, or the last step, end the session."""

    nodes: DataFrame
    searched: Callable[[str, str | None], DataFrame]
    opened: Callable[[str, str, str], DataFrame]
    provider: Provider
    steps: int = 8
    cap: int = 8

    def run(self, question: str, dialogue: list[dict] | None = None, task_type: str | None = None, context: dict | None = None) -> tuple[str, list[dict]]:
        frontier = {r["node_id"]: r for r in self._best(self.searched(question, None))}
        ledger: list[dict] = []
        trace: list[dict] = []
        actions: list[dict] = []
        empty, asked = 0, question
        for step in range(1, self.steps + 1):
            state = {
                "question": question, "task_type": task_type, "subquestion": asked, "frontier": sorted(frontier)[:6], "evidence": [e["evidence_id"] for e in ledger[:6]],
                "recent_actions": actions[-6:], "dialogue": (dialogue or [])[-4:], "global_context": context or {},
                "budget": {"steps_used": step - 1, "steps_remaining": self.steps - step + 1, "evidence": len(ledger)}, "steps_remaining": self.steps - step + 1,
            }
            action = first_json(self.provider.complete(json.dumps(state), None))
            kind, found = action.get("action_type"), []
            actions.append(action)
            if kind == "SEARCH":
                asked = action["query"]
                found = self._best(self.searched(action["query"], action.get("modality")))
            elif kind == "OPEN":
                rows = [r.asDict() for r in self.opened(action["node_id"], action.get("modality") or "visual", question).collect()]
                found = [e | {"evidence_id": f"evidence_{len(ledger) + i:05d}"} for i, e in enumerate(rows, 1)]
                frontier.pop(action["node_id"], None)
                ledger += found
            elif kind == "SPLIT":
                children = self.nodes.filter(F.col("parent_id") == action["node_id"])
                found = [r.asDict() for r in children.select("node_id", "s", "e", F.lit(0.2).alias("score")).collect()]
            elif kind == "MERGE":
                chosen = [e for i in action["evidence_ids"] for e in ledger if e["evidence_id"] == i]
                if chosen:
                    found = [chosen[0] | {"evidence_id": f"evidence_{len(ledger) + 1:05d}", "claim": " | ".join(e["claim"] for e in chosen), "modality": "cross_modal"}]
                    ledger += found
            if kind in ("SEARCH", "SPLIT"):
                for item in found:
                    old = frontier.get(item["node_id"])
                    if old is None or item["score"] >= old["score"]:
                        frontier[item["node_id"]] = item
                best = sorted(frontier.values(), key=lambda r: (-r["score"], r["s"]))[: self.cap]
                frontier = {r["node_id"]: r for r in best}
            trace.append({"step": step, "state": state, "action": action, "found": len(found)})
            if kind == "STOP":
                return action.get("answer") or self._fallback(question, ledger), trace
            empty = empty + 1 if kind == "OPEN" and not found else 0
            if empty >= 2 and ledger:
                break
        return self._fallback(question, ledger), trace

    def _best(self, df: DataFrame) -> list[dict]:
        """The hits that can enter the frontier."""
        order = [F.desc(c) if c == "score" else F.asc(c) for c in ("score", "s", "node_id") if c in df.columns]
        return [r.asDict() for r in df.orderBy(*order).limit(self.cap).collect()]

    def _fallback(self, question: str, ledger: list[dict]) -> str:
        if not ledger:
            return "The budget ended before any evidence was found."
        best = sorted(ledger, key=lambda e: (-e["confidence"], e["s"]))[:4]
        return self.provider.complete(json.dumps({"question": question, "evidence": [e["claim"] for e in best]}), None).strip()


def run_conversation(turns: list[dict], answer: Callable[[str, list[dict]], str], gold: bool = True) -> list[dict]:
    """The turns of one conversation, the assistant's with candidate_response: answer(question, dialogue so far).

    The later turns see the recorded answers (gold) or the given ones. An assistant turn takes
    the user turn before it; one without is an error. Other roles pass through."""
    dialogue: list[dict] = []
    out, pending = [], None
    for i, turn in enumerate(turns):
        role, content = turn.get("role"), str(turn.get("content") or "")
        if role == "assistant":
            if pending is None:
                raise ValueError(f"assistant turn {i} has no question before it")
            said = answer(pending, list(dialogue))
            turn = turn | {"candidate_response": said}
            content, pending = content if gold else said, None
        elif role == "user":
            pending = content
        dialogue.append({"role": role, "content": content})
        out.append(turn)
    return out
