"""Built-in search recipes, and the fusion of their parts."""

from __future__ import annotations

_BM25 = {"k": 50, "k1": 0.9, "b": 0.4, "stemmer": "porter", "stopwords": "lucene33"}
_BASE = {"version": 1, "transform": {"limit": 10}, "control": {"budget_ms": 5000}}
_RRF = {"method": "rrf", "k": 60}

#: The built-in recipes by name, which lists a search takes and how it joins them.
BUILT_IN = {
    "keyword": _BASE | {"retrieve": {"bm25": _BM25}, "fusion": _RRF},
    "semantic": _BASE | {"retrieve": {"vector": {}}},
    "hybrid": _BASE | {"retrieve": {"bm25": _BM25, "vector": {}}, "fusion": _RRF},
    "default": _BASE | {"retrieve": {"bm25": _BM25, "vector": {}}, "fusion": _RRF},
    "graph": _BASE | {"retrieve": {"bm25": _BM25, "graph": {"max_hops": 2, "k": 50}}, "fusion": _RRF | {"weights": {"bm25": 1.0, "graph": 0.3}}},
    "rag": _BASE | {
        "retrieve": {"bm25": _BM25, "vector": {}}, "fusion": _RRF,
        "expansion": {"strategy": "full", "strong_signal_threshold": 0.85, "strong_signal_gap": 0.15, "original_weight": 2.0},
        "rerank": {"top_n": 20, "min_candidates": 3, "blending": {"rank_1_3": 0.75, "rank_4_10": 0.60, "rank_11_plus": 0.40}},
        "rag_context_hits": 5, "rag_max_tokens": 500, "prompt": "Answer from the context alone. Cite sources as [N].",
    },
}


def strong_signal(scores: list[float], threshold: float = 0.85, gap: float = 0.15) -> bool:
    """Whether the best hit stands out so far that a query needs no expansion."""
    return bool(scores) and scores[0] >= threshold and scores[0] - (scores[1] if len(scores) > 1 else 0.0) >= gap


def parse_expansion(answer: str, query: str) -> list[tuple[str, str]]:
    """(kind, text) of the lines lex:, vec: and hyde: of a model's answer; lex and vec must share a word with the query."""
    own = set(query.lower().split())
    out = []
    for line in answer.splitlines():
        kind, colon, text = line.strip().partition(":")
        text = text.strip()
        if colon and text and kind in ("lex", "vec", "hyde") and (kind == "hyde" or own & set(text.lower().split())):
            out.append((kind, text))
    return out


def parse_ratings(answer: str) -> dict[int, float]:
    """Relevance from 0 to 1 by index, from lines "n: score" with scores up to ten."""
    out = {}
    for line in answer.splitlines():
        index, colon, score = line.partition(":")
        try:
            out[int(index.strip().strip("[]"))] = min(max(float(score.strip()), 0.0), 10.0) / 10
        except ValueError:
            continue
    return out


def sandwich(items: list) -> list:
    """The best items at both ends and the worst in the middle, as prompts hold them best."""
    return items[::2] + items[1::2][::-1]


def prompt(question: str, passages: list[str], instruction: str) -> str:
    numbered = sandwich([f"[{i}] {p}" for i, p in enumerate(passages, 1)])
    return "\n\n".join([instruction, *numbered, f"Question: {question}"])


def citations(answer: str, n: int) -> list[int]:
    """The numbers in brackets that name passages, in order, each once."""
    import re

    found = (int(x) for m in re.finditer(r"\[(\d+(?:\s*,\s*\d+)*)\]", answer) for x in m[1].split(","))
    return [i for i in dict.fromkeys(found) if 1 <= i <= n]


def embedding_text(value, depth: int = 16, most: int = 1024) -> str:
    """A value as text to embed: "name: value" lines in order of names, at most `most` bytes."""

    def walk(v, name: str, left: int) -> list[str]:
        if left < 0 or v is None:
            return []
        if isinstance(v, dict):
            return [line for k in sorted(v) for line in walk(v[k], k, left - 1)]
        if isinstance(v, list):
            return [line for x in v for line in walk(x, name, left - 1)]
        text = str(v).lower() if isinstance(v, bool) else str(v)
        return [f"{name}: {text}" if name else text]

    return "\n".join(walk(value, "", depth)).encode()[:most].decode("utf-8", "ignore")
