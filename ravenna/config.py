"""Typed settings with their defaults and constraints."""

from __future__ import annotations

from pathlib import Path
from typing import Any

from pydantic import BaseModel, ConfigDict, Field, model_validator

from ravenna.artifacts import hash_json
from ravenna.sources.files import project_root, read_yaml

#: The known embeddings' checkpoints, templates, limits and widths.
EMBEDDINGS = {
    "colibri": {"checkpoint": "tardellirs/colibri-embed-ptbr", "dtype": "fp32", "query": "task: search result | query: {query}", "document": "title: none | text: {text}", "limit": None, "dimension": 768},
    "qwen_embedding": {"checkpoint": "Qwen/Qwen3-Embedding-4B", "dtype": "fp16", "query": "Instruct: {task}\nQuery:{query}", "document": "{text}", "limit": 8192, "dimension": 2560},
    "e5": {"checkpoint": "intfloat/multilingual-e5-large-instruct", "dtype": "fp32", "query": "Instruct: {task}\nQuery: {query}", "document": "{text}", "limit": 512, "dimension": 1024},
}
TASK = "Given a web search query, retrieve relevant passages that answer the query"
RERANKER = "Qwen/Qwen3-Reranker-0.6B"
REVISIONS = "configs/model_revisions.yaml"


class Strict(BaseModel):
    model_config = ConfigDict(extra="forbid")


class Chunking(Strict):
    target_tokens: int = Field(350, gt=0)
    overlap_tokens: int = Field(50, ge=0)
    require_token_validation: bool = True

    @model_validator(mode="after")
    def _overlap_below_target(self):
        if self.overlap_tokens >= self.target_tokens:
            raise ValueError("overlap_tokens must be less than target_tokens")
        return self


class Bm25(Strict):
    k1: float = Field(1.2, gt=0)
    b: float = Field(0.75, ge=0, le=1)


class Rrf(Strict):
    c: float = Field(60.0, gt=0)
    weight_bm25: float = Field(1.0, gt=0)
    weight_dense: float = Field(1.0, gt=0)


class Lexical(Strict):
    lowercase: bool = True
    strip_accents: bool = False
    unicode_nfkc: bool = True
    token_pattern: str = r"\w+"

    @model_validator(mode="after")
    def _as_indexed(self):
        if self.strip_accents or self.token_pattern != r"\w+":
            raise ValueError(r"accents are kept and tokens are \w+; other settings have no index")
        return self

    def how(self) -> dict[str, bool]:
        """The arguments of the text functions."""
        return {"lowercase": self.lowercase, "compatibility": self.unicode_nfkc}


class Retrieval(Strict):
    top_n: int = Field(50, gt=0)
    bm25: Bm25 = Bm25()
    rrf: Rrf = Rrf()
    lexical: Lexical = Lexical()
    normalize_embeddings: bool = True
    cosine_similarity: bool = True

    @model_validator(mode="after")
    def _cosine_only(self):
        if not (self.normalize_embeddings and self.cosine_similarity):
            raise ValueError("cosine similarity and normalised embeddings are mandatory")
        return self


class Experiments(Strict):
    embeddings: list[str] = ["colibri", "qwen_embedding", "e5"]
    select: list[str] | None = None
    include_reranker: bool = True
    seed: int = 42

    @model_validator(mode="after")
    def _known_once(self):
        if unknown := set(self.embeddings) - set(EMBEDDINGS):
            raise ValueError(f"unknown embeddings {sorted(unknown)}")
        if len(set(self.embeddings)) < len(self.embeddings):
            raise ValueError("an embedding repeats")
        return self


class Reranker(Strict):
    checkpoint: str = RERANKER
    instruction: str = TASK
    max_length: int = Field(8192, gt=0)

    @model_validator(mode="after")
    def _fixed(self):
        if (self.checkpoint, self.instruction) != (RERANKER, TASK):
            raise ValueError("the reranker and its instruction are fixed")
        return self


class Generator(Strict):
    model: str = "qwen3:14b"
    host: str = "http://127.0.0.1:11434"
    temperature: float = Field(0.0, ge=0)
    seed: int | None = None
    num_ctx: int = Field(8192, gt=0)
    reasoning: bool = False


class Models(Strict):
    cache_dir: str = "artifacts/models"
    revisions_path: str = REVISIONS
    reranker: Reranker = Reranker()
    generator: Generator = Generator()

    @model_validator(mode="after")
    def _audited(self):
        if self.revisions_path != REVISIONS:
            raise ValueError(f"revisions come from {REVISIONS}")
        return self


class Generation(Strict):
    prompt_template: str | None = None
    top_k_context: int = Field(5, gt=0)
    context_budget_tokens: int = Field(4000, gt=0)
    response_reserve_tokens: int = Field(512, ge=0)
    human_eval_shuffle_seed: int = 7


class Metrics(Strict):
    k_values: list[int] = [1, 5, 10]
    primary: str = "ndcg@10"


class Settings(Strict):
    root: Path = Field(default_factory=project_root)
    chunking: Chunking = Chunking()
    retrieval: Retrieval = Retrieval()
    experiments: Experiments = Experiments()
    models: Models = Models()
    generation: Generation = Generation()
    metrics: Metrics = Metrics()

    def portable(self) -> dict[str, Any]:
        """All settings but the machine's own path."""
        return self.model_dump(mode="json", exclude={"root"})

    def fingerprint(self) -> str:
        return hash_json(self.portable())


def load_settings(path: str | Path | None = None) -> Settings:
    return Settings.model_validate(read_yaml(path) if path else {})
