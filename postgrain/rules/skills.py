"""The skill lexicon. Callers may pass their own list of :class:`Skill`."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Skill:
    canonical: str
    aliases: tuple[str, ...] = ()
    rare: bool = False
    list_aliases: tuple[str, ...] = ()  # count only as a whole entry of a skill list


# Fixed values.
SKILLS = (
    Skill("agents", ("agentic", "ai agent", "ai agents", "autonomous agents"), True),
    Skill("tool use", ("function calling", "tool calling"), True),
    Skill("orchestration", ("agent orchestration", "multi-agent", "multi agent"), True),
    Skill("mcp", ("model context protocol",), True),
    Skill("rag", ("retrieval augmented generation", "retrieval-augmented generation"), True),
    Skill("evals", ("eval", "evaluation harness", "llm evaluation"), True),
    Skill("prompt engineering", ("prompting", "prompt design"), True),
    Skill("langgraph", (), True),
    Skill("langchain"),
    Skill("llamaindex", ("llama index",)),
    Skill("claude", ("anthropic",), True),
    Skill("openai", ("gpt-4", "gpt-5")),
    Skill("fine-tuning", ("fine tuning", "finetuning", "lora")),
    Skill("inference", ("vllm", "model serving", "triton")),
    Skill("vector database", ("pinecone", "weaviate", "pgvector", "qdrant", "chroma")),
    Skill("python"),
    Skill("typescript", ("ts",)),
    Skill("javascript", ("node.js", "nodejs", "node")),
    Skill("bun", (), True),
    Skill("react", ("react.js", "reactjs")),
    Skill("sql"),
    Skill("postgres", ("postgresql",)),
    Skill("sqlite"),
    Skill("power bi", ("powerbi", "dax"), True),
    Skill("pandas"),
    Skill("pytorch", ("torch",)),
    Skill("tensorflow"),
    Skill("scikit-learn", ("sklearn", "scikit learn")),
    Skill("docker", ("containers",)),
    Skill("kubernetes", ("k8s",)),
    Skill("aws", ("amazon web services",)),
    Skill("gcp", ("google cloud",)),
    Skill("azure"),
    Skill("terraform"),
    Skill("airflow"),
    Skill("dbt"),
    Skill("spark", ("pyspark",)),
    Skill("fastapi"),
    Skill("graphql"),
    Skill("golang", ("go lang",), False, ("go",)),
    Skill("observability"),
    Skill("distributed systems"),
    Skill("ci/cd", ("cicd", "continuous integration")),
    Skill("llm", ("llms", "large language model", "large language models")),
    Skill("workflows", ("workflow",)),
    Skill("end-to-end", ("end to end",)),
    Skill("presales", ("pre-sales", "solutions engineer", "solutions architect"), True),
    Skill("customer facing", ("customer-facing", "client facing", "client-facing"), True),
    Skill("stakeholder management", (), True),
    Skill("proof of concept", ("poc", "prototype")),
    Skill("consulting"),
    Skill("cross functional", ("cross-functional",)),
    Skill("mentoring", ("mentorship",)),
    Skill("technical writing"),
    Skill("data pipeline", ("data pipelines",)),
    Skill("etl", ("elt",)),
    Skill("data modeling"),
)

RARE_SKILLS = tuple(s.canonical for s in SKILLS if s.rare)


def prose_terms(skills=SKILLS) -> dict[str, str]:
    """Term -> canonical name, for terms that count anywhere in running text."""
    return {term: s.canonical for s in skills for term in (s.canonical, *s.aliases)}


def entry_terms(skills=SKILLS) -> dict[str, str]:
    """Term -> canonical name, for whole entries of a curated list."""
    return {
        term: s.canonical for s in skills for term in (s.canonical, *s.aliases, *s.list_aliases)
    }
