"""Extraction, choices and answers by a language model, behind one function from prompts to a completion.

The client is whatever function the user has; it has to be serialisable, as it runs in executors. Every call goes through the retry
policy, which tells the model what went wrong before, and every answer is checked for its shape.
"""

from __future__ import annotations

import json
import logging
import warnings
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from pathlib import Path

from graphloom.functions.models import PROMPTS, RetryPolicy

log = logging.getLogger(__name__)

#: What each kind of call tells the model besides its system prompt; the fields are those that the call fills.
USER_PROMPTS: dict[str, str] = {
    "triplet_extraction": "Text:\n{text}",
    "entity_types_ranker": "Text:\n{text}\nFact: {fact}\nSubject types: {subject_types}\nObject types: {object_types}",
    "relation_ranker": "Text:\n{text}\nFact: {fact}\nRelations: {relations}",
    "relation_ranker_wo_entity_types": "Text:\n{text}\nFact: {fact}\nRelations: {relations}",
    "relation_and_entity_types_ranker": "Text:\n{text}\nFact: {fact}\nCandidates: {candidates}",
    "subject_ranker": "Text:\n{text}\nFact: {fact}\nName: {name}\nKnown names: {candidates}",
    "object_ranker": "Text:\n{text}\nFact: {fact}\nName: {name}\nKnown names: {candidates}",
    "question_entity_extractor": "Question: {question}",
    "question_entity_ranker": "Question: {question}\nEntities: {entities}",
    "qa": "Question: {question}\nFacts:\n{facts}",
    "question_decomposition_1": "Question: {question}",
    "qa_collapsing": "Original question: {original}\nQuestion: {question}\nAnswer: {answer}",
    "qa_is_answered": "Original question: {original}\nSteps:\n{steps}",
}


@dataclass(frozen=True)
class Completion:
    text: str
    prompt_tokens: int = 0
    completion_tokens: int = 0


def read_prompts(folder: str | None) -> dict[str, str]:
    """System prompts from ``<kind>.txt`` files; a kind without a file gets the shape that its answer must have, with a warning."""
    out = {}
    for kind in USER_PROMPTS:
        path = Path(folder) / f"{kind}.txt" if folder else None
        if path is not None and not path.exists():
            warnings.warn(f"no prompt file {path}", stacklevel=2)
        out[kind] = path.read_text(encoding="utf-8") if path is not None and path.exists() else f"Answer with: {PROMPTS.get(kind, 'plain text')}."
    return out


def first_json(text: str) -> object:
    """The first JSON object or list in an answer, which may be fenced or amid prose; ValueError if there is none."""
    decoder = json.JSONDecoder()
    for at, c in enumerate(text):
        if c in "{[":
            try:
                return decoder.raw_decode(text, at)[0]
            except json.JSONDecodeError:
                continue
    raise ValueError(f"no JSON in {text[:80]!r}")


@dataclass
class LanguageModel:
    """``client`` (system prompt, user prompt) with retries, prompts and a count of tokens."""

    client: Callable[[str, str], Completion]
    prompts: dict[str, str] = field(default_factory=lambda: read_prompts(None))
    retry: RetryPolicy = RetryPolicy()
    prompt_tokens: int = 0
    completion_tokens: int = 0

    def ask(self, kind: str, parse: Callable[[str], object] = str.strip, **fields: object) -> object:
        """The parsed answer; an answer that does not parse is asked for again, with the error."""
        user = USER_PROMPTS[kind].format(**fields)

        def call(error: str | None) -> object:
            system = self.prompts[kind] + (f"\nThe last answer was rejected: {error}" if error else "")
            said = self.client(system, user)
            self.prompt_tokens += said.prompt_tokens
            self.completion_tokens += said.completion_tokens
            log.debug("%s: %s", kind, said.text)
            return parse(said.text)

        return self.retry.run(call)


def _shape(wanted: type, *names: str) -> Callable[[str], object]:
    def parse(text: str) -> object:
        value = first_json(text)
        if not isinstance(value, wanted) or any(n not in value for n in names):
            raise ValueError(f"not {wanted.__name__} with {', '.join(names)}" if names else f"not {wanted.__name__}")
        return value

    return parse


def _triplets(text: str) -> list[dict]:
    value = _shape(dict, "triplets")(text)["triplets"]
    if not isinstance(value, list) or not all(isinstance(t, dict) for t in value):
        raise ValueError("triplets is not a list of objects")
    return value


def _none(text: str) -> str | None:
    return None if not text.strip() or text.strip(" .\"'`*") == "None" else text.strip()


@dataclass
class ModelExtractor:
    model: LanguageModel

    def __call__(self, text: str) -> list[dict]:
        return self.model.ask("triplet_extraction", _triplets, text=text)


@dataclass
class ModelChooser:
    """Picks among candidates by one kind of call; what is not among them is none of them."""

    model: LanguageModel
    kind: str = "subject_ranker"

    def __call__(self, name: str, candidates: Sequence[str], context: str = "") -> str | None:
        if not candidates:
            return None
        listed = json.dumps(list(candidates), ensure_ascii=False)
        if self.kind == "relation_ranker":
            said = self.model.ask(self.kind, _shape(dict, "relation"), text=context, fact=name, relations=listed)["relation"]
        elif self.kind == "relation_ranker_wo_entity_types":
            said = self.model.ask(self.kind, _none, text=context, fact=name, relations=listed)
        elif self.kind == "entity_types_ranker":
            said = self.model.ask(self.kind, _shape(dict, "subject_type"), text=context, fact=name, subject_types=listed, object_types="[]")["subject_type"]
        else:
            said = self.model.ask(self.kind, _none, text=context, fact="", name=name, candidates=listed)
        return said if said in candidates else None


@dataclass
class ModelLinker:
    """Names in a question, and those of the graph's names that it is about."""

    model: LanguageModel

    def __call__(self, question: str) -> list[str]:
        return [str(n) for n in self.model.ask("question_entity_extractor", _shape(list), question=question)]

    def relevant(self, question: str, names: Sequence[str]) -> list[str]:
        said = self.model.ask("question_entity_ranker", _shape(list), question=question, entities=json.dumps(list(names), ensure_ascii=False))
        chosen = [s["entity"] if isinstance(s, dict) else s for s in said]
        return [n for n in names if n in chosen]


@dataclass
class ModelAnswerer:
    model: LanguageModel

    def __call__(self, question: str, facts: Sequence[tuple[str, str, str]]) -> str | None:
        return self.model.ask("qa", _none, question=question, facts="\n".join(", ".join(f) for f in facts))


@dataclass
class ModelStepper:
    model: LanguageModel

    def decompose(self, question: str) -> str:
        return self.model.ask("question_decomposition_1", question=question)

    def collapse(self, question: str, step: str, answer: str | None) -> str:
        return self.model.ask("qa_collapsing", original=question, question=step, answer=answer)

    def settled(self, question: str, asked: Sequence[str], answers: Sequence[str | None]) -> str | None:
        steps = "\n".join(f"{q} {a}" for q, a in zip(asked, answers, strict=True))
        said = self.model.ask("qa_is_answered", original=question, steps=steps)
        return None if said == "NOT FINAL" else said
