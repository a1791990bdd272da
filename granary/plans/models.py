"""The model registry: a small dimension table, and what budgets need of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from granary.errors import UnknownModelError

# Model, provider, encoding, context window, dollars per million input and output tokens.
MODELS: dict[str, tuple[str, str, int, float, float]] = {
    "gpt-4o": ("openai", "o200k_base", 128000, 2.5, 10.0),
    "gpt-4o-mini": ("openai", "o200k_base", 128000, 0.15, 0.6),
    "gpt-4.1": ("openai", "o200k_base", 1000000, 2.0, 8.0),
    "gpt-4.1-mini": ("openai", "o200k_base", 1000000, 0.8, 3.2),
    "gpt-4.1-nano": ("openai", "o200k_base", 1000000, 0.2, 0.8),
    "gpt-5": ("openai", "o200k_base", 400000, 1.25, 10.0),
    "gpt-5-mini": ("openai", "o200k_base", 400000, 0.25, 2.0),
    "gpt-5-nano": ("openai", "o200k_base", 400000, 0.05, 0.4),
    "gpt-5.2": ("openai", "o200k_base", 400000, 1.75, 14.0),
    "gpt-5.3-codex": ("openai", "o200k_base", 400000, 2.5, 10.0),
    "o3-mini": ("openai", "o200k_base", 200000, 1.1, 4.4),
    "o4-mini": ("openai", "o200k_base", 200000, 4.0, 16.0),
    "claude-3-5-sonnet": ("anthropic", "cl100k_base", 200000, 3.0, 15.0),
    "claude-3-7-sonnet": ("anthropic", "cl100k_base", 200000, 3.0, 15.0),
    "claude-4-sonnet": ("anthropic", "cl100k_base", 200000, 3.0, 15.0),
    "claude-4-5-sonnet": ("anthropic", "cl100k_base", 200000, 3.0, 15.0),
    "claude-opus-4-5": ("anthropic", "cl100k_base", 200000, 5.0, 25.0),
    "claude-3-5-haiku": ("anthropic", "cl100k_base", 200000, 0.8, 4.0),
    "claude-haiku-4-5": ("anthropic", "cl100k_base", 200000, 1.0, 5.0),
    "gemini-2-0-flash": ("google", "cl100k_base", 1000000, 0.1, 0.4),
    "gemini-2-5-flash": ("google", "cl100k_base", 1000000, 0.3, 2.5),
    "gemini-2-5-flash-lite": ("google", "cl100k_base", 1000000, 0.1, 0.4),
    "gemini-2-5-pro": ("google", "cl100k_base", 1000000, 1.25, 10.0),
    "llama-4-maverick": ("meta", "cl100k_base", 1000000, 0.15, 0.6),
    "llama-4-scout": ("meta", "cl100k_base", 1000000, 0.08, 0.3),
    "deepseek-v3-2": ("deepseek", "cl100k_base", 128000, 0.28, 0.42),
    "deepseek-r1": ("deepseek", "cl100k_base", 128000, 0.55, 2.19),
    "grok-3": ("xai", "cl100k_base", 131072, 3.0, 15.0),
    "grok-4-fast": ("xai", "cl100k_base", 131072, 0.2, 0.5),
    "mistral-large": ("mistral", "cl100k_base", 128000, 2.0, 6.0),
    "mistral-small": ("mistral", "cl100k_base", 32000, 0.2, 0.6),
    "cohere-command-r-plus": ("cohere", "cl100k_base", 128000, 2.5, 10.0),
    "qwen-2-5-72b": ("qwen", "cl100k_base", 128000, 0.9, 3.0),
    "amazon-nova-pro": ("amazon", "cl100k_base", 300000, 0.8, 3.2),
    "gpt-5.2-pro": ("openai", "o200k_base", 400000, 21.0, 168.0),
    "claude-opus-4-6": ("anthropic", "cl100k_base", 200000, 5.0, 25.0),
    "claude-sonnet-4-6": ("anthropic", "cl100k_base", 200000, 3.0, 15.0),
    "gemini-3-pro": ("google", "cl100k_base", 1000000, 2.0, 12.0),
    "gemini-3-flash": ("google", "cl100k_base", 1000000, 0.5, 3.0),
    "gpt-4": ("openai", "cl100k_base", 8192, 30.0, 60.0),
    "gpt-4-turbo": ("openai", "cl100k_base", 128000, 10.0, 30.0),
    "gpt-3.5-turbo": ("openai", "cl100k_base", 16385, 0.5, 1.5),
}
DEFAULT_WINDOW = 128000
_BUILT_IN = dict(MODELS)


def register_model(name: str, provider: str, encoding: str, window: int, input_price: float, output_price: float) -> None:
    MODELS[name] = (provider, encoding, window, input_price, output_price)


def reset_models() -> None:
    MODELS.clear()
    MODELS.update(_BUILT_IN)


def model(name: str) -> tuple[str, str, int, float, float]:
    if name not in MODELS:
        raise UnknownModelError(name)
    return MODELS[name]


def models_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in MODELS.items()], "model string, provider string, encoding string, window long, input_price double, output_price double")


def models_sql() -> str:
    """The registry as SQL VALUES."""
    rows = ", ".join(f"('{k}', '{v[0]}', '{v[1]}', {v[2]}, {v[3]!r}::DOUBLE, {v[4]!r}::DOUBLE)" for k, v in MODELS.items())
    return f"(VALUES {rows}) AS models(model, provider, encoding, window_, input_price, output_price)"
