"""Company boards that are known from the start."""

from __future__ import annotations

# Fixed values: (company, provider, board token, whether the board is known to work).
BOARD_SEEDS = (
    ("Anthropic", "greenhouse", "anthropic", True),
    ("AssemblyAI", "greenhouse", "assemblyai", True),
    ("Scale AI", "greenhouse", "scaleai", True),
    ("Cresta", "greenhouse", "cresta", True),
    ("Databricks", "greenhouse", "databricks", True),
    ("Figma", "greenhouse", "figma", True),
    ("Glean", "greenhouse", "gleanwork", True),
    ("Vercel", "greenhouse", "vercel", True),
    ("Airtable", "greenhouse", "airtable", True),
    ("Discord", "greenhouse", "discord", True),
    ("Together AI", "greenhouse", "togetherai", True),
    ("CoreWeave", "greenhouse", "coreweave", True),
    ("Weights and Biases", "greenhouse", "weightsandbiases", False),
    ("Replicate", "greenhouse", "replicate", False),
    ("Sourcegraph", "greenhouse", "sourcegraph91", True),
    ("Observe.AI", "greenhouse", "observeai", True),
    ("Sigma Computing", "greenhouse", "sigmacomputing", True),
    ("Fivetran", "greenhouse", "fivetran", True),
    ("Dagster Labs", "greenhouse", "dagsterlabs", True),
    ("Cribl", "greenhouse", "cribl", True),
    ("Imbue", "greenhouse", "imbue", True),
    ("Thinking Machines Lab", "greenhouse", "thinkingmachines", True),
    ("Arize AI", "greenhouse", "arizeai", True),
    ("Comet", "greenhouse", "comet", True),
    ("Hex Technologies", "greenhouse", "hextechnologies", True),
    ("Cloudflare", "greenhouse", "cloudflare", True),
    ("Stripe", "greenhouse", "stripe", True),
    ("Figure AI", "greenhouse", "figureai", True),
    ("Galileo", "greenhouse", "rungalileo", False),
    ("Mistral AI", "lever", "mistral", True),
    ("Tinybird", "lever", "tinybird", True),
    ("Contextual AI", "lever", "contextualai", False),
    ("Anyscale", "lever", "anyscale", False),
    ("Aleph Alpha", "ashby", "alephalpha", True),
    ("Attio", "ashby", "attio", True),
    ("Baseten", "ashby", "baseten", True),
    ("Bland AI", "ashby", "bland", True),
    ("Causaly", "ashby", "causaly", True),
    ("Character AI", "ashby", "character", True),
    ("Clay Labs", "ashby", "claylabs", True),
    ("Clerk", "ashby", "clerk", True),
    ("Cognition", "ashby", "cognition", True),
    ("Cohere", "ashby", "cohere", True),
    ("Corti", "ashby", "corti", True),
    ("Cradle", "ashby", "cradlebio", True),
    ("Decagon", "ashby", "decagon", True),
    ("DeepL", "ashby", "deepl", True),
    ("Deepgram", "ashby", "deepgram", True),
    ("ElevenLabs", "ashby", "elevenlabs", True),
    ("Faculty", "ashby", "faculty", True),
    ("Fireworks AI", "ashby", "fireworksai", True),
    ("Glacis AI", "ashby", "glacis-ai", True),
    ("Harvey", "ashby", "harvey", True),
    ("Inngest", "ashby", "inngest", True),
    ("Klue", "ashby", "klue", True),
    ("Lakera", "ashby", "lakera.ai", True),
    ("LangChain", "ashby", "langchain", True),
    ("Legora", "ashby", "legora", True),
    ("LlamaIndex", "ashby", "llamaindex", True),
    ("Lovable", "ashby", "lovable", True),
    ("Modal Labs", "ashby", "modal", True),
    ("Notion", "ashby", "notion", True),
    ("OpenAI", "ashby", "openai", True),
    ("Perk", "ashby", "perk", True),
    ("Perplexity", "ashby", "perplexity", True),
    ("Photoroom", "ashby", "photoroom", True),
    ("Pinecone", "ashby", "pinecone", True),
    ("Pleo", "ashby", "pleo", True),
    ("Ramp", "ashby", "ramp", True),
    ("Resend", "ashby", "resend", True),
    ("Runway", "ashby", "runway", True),
    ("Sierra AI", "ashby", "sierra", True),
    ("Supabase", "ashby", "supabase", True),
    ("Synthesia", "ashby", "synthesia", True),
    ("Vapi", "ashby", "vapi", True),
    ("WorkOS", "ashby", "workos", True),
    ("Zapier", "ashby", "zapier", True),
    ("n8n", "ashby", "n8n", True),
    ("Anyscale", "ashby", "anyscale", True),
    ("Cursor", "ashby", "cursor", True),
    ("Replit", "ashby", "replit", True),
    ("Writer", "ashby", "writer", True),
    ("Abridge", "ashby", "abridge", True),
    ("OpenEvidence", "ashby", "openevidence", True),
    ("Cerebras", "ashby", "cerebras", True),
    ("Lambda", "ashby", "lambda", True),
    ("Braintrust", "ashby", "braintrust", True),
    ("Weaviate", "ashby", "weaviate", True),
    ("Chroma", "ashby", "trychroma", True),
    ("Temporal", "ashby", "temporal", True),
    ("Linear", "ashby", "linear", True),
    ("Airbyte", "ashby", "airbyte", True),
    ("Snowflake", "ashby", "snowflake", True),
    ("Astronomer", "ashby", "astronomer", True),
    ("Distyl AI", "ashby", "distyl", True),
    ("Mercor", "ashby", "mercor", True),
    ("Luma AI", "ashby", "lumaai", True),
    ("Suno", "ashby", "suno", True),
    ("Poolside", "ashby", "poolside", True),
    ("Reflection AI", "ashby", "reflectionai", True),
    ("Physical Intelligence", "ashby", "physicalintelligence", True),
    ("Vellum", "ashby", "vellum", True),
    ("Unstructured", "ashby", "unstructured", True),
    ("Letta", "ashby", "letta", True),
    ("Composio", "ashby", "composio", True),
    ("E2B", "ashby", "e2b", True),
    ("Sardine", "ashby", "sardine", True),
    ("Speak", "ashby", "speak", True),
    ("Granola", "ashby", "granola", True),
    ("Groq", "greenhouse", "groq", False),
    ("Hebbia", "greenhouse", "hebbia", False),
    ("dbt Labs", "greenhouse", "dbtlabs", False),
    ("Retool", "greenhouse", "retool", False),
    ("Qdrant", "greenhouse", "qdrant", False),
    ("Ironclad", "greenhouse", "ironclad", False),
    ("Rippling", "greenhouse", "rippling", False),
    ("Plaid", "greenhouse", "plaid", False),
    ("Applied Intuition", "greenhouse", "appliedintuition", False),
    ("Sakana AI", "greenhouse", "sakanaai", False),
    ("Skild AI", "greenhouse", "skild", False),
    ("CrewAI", "greenhouse", "crewai", False),
    ("Hugging Face", "workable", "huggingface", True),
    ("Lindy", "teamtailor", "lindy.na", True),
)
