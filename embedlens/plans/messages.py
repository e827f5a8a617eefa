"""Texts that users of the analyses already match on."""

# health: name -> (category, message, recommendation)
HEALTH = {
    "completeness": ("schema_inconsistency", "Metadata completeness is {:.0f}%", "Consider adding missing metadata fields"),
    "empty": ("orphans", "Estimated {} vectors with missing or empty content", "Run orphan detection for detailed analysis"),
    "missing": ("orphans", "Estimated {} vectors with missing embeddings", "Re-embed vectors or remove entries without embeddings"),
    "wide": ("performance", "High dimension count ({}) may impact performance", "Consider dimensionality reduction if query latency is high"),
    "large": ("storage", "Large collection with {} vectors", "Ensure adequate resources and consider sharding"),
    "mixed": ("model_drift", "Possible mixed embedding models detected (bimodality coefficient: {:.2f})", "Run Fingerprint Analysis to identify model groups"),
    "distance": ("distance_health", "Poor distance discrimination (ratio: {:.2f})", "Run Distance Health analysis for detailed assessment"),
    "stale": ("staleness", "Median data age is {:.0f} days (field: {})", "Run Staleness Analysis for detailed age distribution"),
    "short": ("chunk_quality", "{:.0f}% of chunks are very short (<50 chars)", "Run Chunk Quality analysis to identify problematic chunks"),
}

# performance, in the notation of format_string
WIDE = "Collection '%s' uses %d-dimensional vectors. Consider dimensionality reduction if query performance is slow."
WIDE_SAVINGS = "Reducing dimensions by %dx could save ~%s memory"
LARGE = "Collection '%s' has %s vectors. Consider sharding or horizontal scaling for better performance."
MEMORY = "Total estimated memory usage is %s. Ensure your system has adequate RAM to avoid disk spillover."
INDEX = "Consider tuning HNSW index parameters (ef, efConstruction, maxConnections) for optimal query/build time tradeoff."

# distance health
TOO_FEW = "Need at least 2 vectors for analysis"
UNIFORM = "Poor distance discrimination - vectors are too uniformly spaced. Consider using a different embedding model or reducing dimensionality."
FEW_DIMENSIONS = "Only {0} of {1} dimensions contribute meaningful variance. Consider PCA or dimensionality reduction to {0}."
LOW_RECALL = "ANN recall@{} is {:.0f}%. Consider increasing ef/efConstruction HNSW parameters."
