"""Fixed values that results depend on. They are data, not logic."""

# USD per 1 000 tokens (input, output) by lower-cased model name.
MODEL_PRICES = {
    "claude-3-5-sonnet": (0.003, 0.015),
    "claude-3-5-sonnet-20241022": (0.003, 0.015),
    "claude-3-opus": (0.015, 0.075),
    "claude-haiku-4-5-20251001": (0.00025, 0.00125),
    "claude-sonnet-4-6": (0.003, 0.015),
    "gpt-4": (0.03, 0.06),
    "gpt-4-turbo": (0.01, 0.03),
    "gpt-3.5-turbo": (0.0005, 0.0015),
    "gemini-pro": (0.0005, 0.0015),
    "llama-2-70b": (0.0, 0.0),
    "mistral-large": (0.0, 0.0),
    "palm-2": (0.001, 0.002),
    "davinci-003": (0.002, 0.002),
}
DEFAULT_PRICE = (0.001, 0.002)

# Latency range in ms used when a row carries none.
LATENCY_RANGES = {
    "claude-3-5-sonnet": (300, 800),
    "claude-3-opus": (400, 900),
    "gpt-4": (250, 600),
    "gpt-4-turbo": (280, 650),
    "gpt-3.5-turbo": (150, 500),
    "llama-2-70b": (600, 2000),
    "mistral-large": (500, 1500),
    "gemini-pro": (300, 800),
    "palm-2": (350, 900),
    "davinci-003": (200, 700),
}
DEFAULT_LATENCY_RANGE = (500, 2000)

# Dataset and score labels.
ARENA = "lmsys"
BENCHMARK = "evals_benchmark"
EVAL_TYPES = ("llm_judge", "bleu", "rouge", "rules", "human_preference", "human")
PREFERENCE = "human_preference"

# Score histogram labels with their lower edges.
SCORE_BUCKETS = (
    ("0–20%", None),
    ("20–40%", 0.2),
    ("40–60%", 0.4),
    ("60–80%", 0.6),
    ("80–100%", 0.8),
)

# Users that loaded calls are spread over.
ARENA_USERS = 20
SINGLE_MODEL_USERS = 15

# Texts written into loaded or judged rows.
ARENA_EXPLANATION = "LMSYS Chatbot Arena human judge"
BENCHMARK_MODEL = "eval-dataset"
BENCHMARK_USER = "benchmark"
BENCHMARK_CRITERIA = "helpful, accurate, relevant"
UPLOAD_MODEL = "uploaded"
JUDGE_CRITERIA = "Is this response helpful and accurate?"
JUDGE_TEMPLATE = (
    "You are an impartial evaluator. Score the following response on a scale "
    "from 0 to 10 based on this criteria: {criteria}\n\n"
    "Prompt: {prompt}\n\nResponse: {response}\n\n"
    'Reply with JSON only: {{"score": <number 0-10>, "explanation": "<one sentence>"}}'
)
EXPLANATION_TEMPLATE = (
    "Explain in detail why the following response is good or bad.\n\n"
    "Prompt: {prompt}\nResponse: {response}"
)
EXPLANATION_CRITERIA = "\nCriteria: {criteria}"
RATERS = ("alice", "bob", "carol", "david", "eve")
RATING_TIERS = (("excellent", 8, 10), ("mediocre", 4, 7), ("poor", 1, 3))

# Ingest limits.
MAX_BATCH_ITEMS = 1000
MAX_BATCH_FAILURES = 50

# E-mail shape accepted for users.
EMAIL_PATTERN = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}$"
