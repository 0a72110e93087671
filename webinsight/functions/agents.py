"""Crawler classification by user agent: ordered patterns, the first that matches wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Family, class, pattern.
FAMILIES = [
    ("OpenAI", "ai", "gptbot|chatgpt-user|oai-searchbot"),
    ("Anthropic", "ai", "claudebot|claude-web|claude-user|claude-searchbot|anthropic-ai"),
    ("Perplexity", "ai", "perplexitybot|perplexity-user"),
    ("Google-AI", "ai", "google-extended|google-cloudvertexbot"),
    ("Apple-AI", "ai", "applebot-extended"),
    ("Meta-AI", "ai", "meta-externalagent|meta-externalfetcher"),
    ("ByteDance", "ai", "bytespider|tiktokspider"),
    ("Amazon", "ai", "amazonbot"),
    ("CommonCrawl", "ai", "ccbot"),
    ("Mistral", "ai", "mistralai-user"),
    ("Cohere", "ai", "cohere-ai|cohere-training-data-crawler"),
    ("DuckAssist", "ai", "duckassistbot"),
    ("You.com", "ai", "youbot"),
    ("AllenAI", "ai", "ai2bot"),
    ("Diffbot", "ai", "diffbot"),
    ("Webz.io", "ai", "omgilibot|omgili|webzio-extended"),
    ("Timpi", "ai", "timpibot"),
    ("ImageSift", "ai", "imagesiftbot"),
    ("GoogleOther", "search", "googleother"),
    ("Googlebot", "search", "googlebot|google-inspectiontool|storebot-google|google favicon|apis-google|adsbot-google|mediapartners-google"),
    ("Bing", "search", "bingbot|adidxbot|msnbot|bingpreview"),
    ("Apple", "search", "applebot"),
    ("DuckDuckGo", "search", "duckduckbot"),
    ("Yandex", "search", "yandex"),
    ("Baidu", "search", "baiduspider"),
    ("Petal", "search", "petalbot|aspiegel"),
    ("Naver", "search", "yeti/|naver"),
    ("Seznam", "search", "seznambot"),
    ("Sogou", "search", "sogou"),
    ("Social", "social", "facebookexternalhit|facebookbot|twitterbot|linkedinbot|slackbot|whatsapp|discordbot|telegrambot|pinterest"),
    ("SEO-tools", "seo-tool", r"ahrefsbot|semrushbot|mj12bot|dotbot|dataforseo|screaming frog|sitebulb|seokicks|blexbot|barkrowler"),
    ("Monitoring", "monitoring", "uptimerobot|pingdom|newrelic|datadog|statuscake"),
    ("other-bot", "other", r"bot\b|crawler|spider|slurp|scrape|http-client|curl|wget|python-requests|go-http|java/|scrapy|firecrawl"),
]

#: Spellings of crawler names.
NAMES = [
    "GPTBot", "ChatGPT-User", "OAI-SearchBot", "ClaudeBot", "Claude-Web", "Claude-User", "Claude-SearchBot", "PerplexityBot", "Perplexity-User",
    "Google-Extended", "Google-CloudVertexBot", "GoogleOther-Image", "GoogleOther-Video", "GoogleOther", "Googlebot-Image", "Googlebot-Video",
    "Googlebot-News", "Googlebot", "Storebot-Google", "Google-InspectionTool", "AdsBot-Google-Mobile", "AdsBot-Google", "Mediapartners-Google",
    "APIs-Google", "bingbot", "adidxbot", "msnbot", "BingPreview", "Applebot-Extended", "Applebot", "meta-externalagent", "meta-externalfetcher",
    "facebookexternalhit", "Twitterbot", "LinkedInBot", "Bytespider", "Amazonbot", "CCBot", "YandexBot", "YandexImages", "Baiduspider", "PetalBot",
    "SeznamBot", "DuckDuckBot", "DuckAssistBot", "MistralAI-User", "cohere-ai", "YouBot", "AI2Bot", "Diffbot", "Omgilibot", "Webzio-Extended",
    "Timpibot", "ImagesiftBot", "AhrefsBot", "SemrushBot", "MJ12bot", "DotBot",
]


#: Distinct agents up to which their table is broadcast.
MOST_AGENTS = 10_000


def _case(pairs, value: str) -> Column:
    """A CASE over conditions or values, as one SQL text: built and parsed once."""
    return F.expr("case " + value + " " + " ".join(f"when {k} then '{v}'" for k, v in pairs) + " end")


def family(ua: str) -> Column:
    """Of a column's name. Null for agents that no pattern matches; the union of all patterns is tried first."""
    each = _case(((f"`{ua}` rlike r'(?i){p}'", name) for name, _, p in FAMILIES), "")
    return F.when(F.col(ua).rlike("(?i)" + "|".join(p for _, _, p in FAMILIES)), each)


def agent_class(fam: str) -> Column:
    return _case(((f"'{name}'", kind) for name, kind, _ in FAMILIES), f"`{fam}`")


def agent_name(ua: str, fam: str) -> Column:
    """The longest listed name in the agent, in the list's spelling; the family where there is none."""
    any_name = "(?i)(" + "|".join(sorted((n.replace(".", r"\.") for n in NAMES), key=len, reverse=True)) + ")"
    spelling = _case(((f"'{n.lower()}'", n) for n in NAMES), f"lower(regexp_extract(`{ua}`, r'{any_name}', 1))")
    return F.when(F.col(fam).isNotNull(), F.coalesce(spelling, F.col(fam)))


def _classified(rows: DataFrame, ua: str) -> DataFrame:
    """One step reads the last one's columns, so each is evaluated once a row."""
    from webinsight.functions.norm import percent_decode

    rows = rows.withColumn("__plain", percent_decode(F.col(ua))).withColumn("bot_family", family("__plain"))
    return rows.withColumn("bot_class", agent_class("bot_family")).withColumn("bot_name", agent_name("__plain", "bot_family")).drop("__plain")


def classify_agents(hits: DataFrame, ua: str = "ua", most: int = MOST_AGENTS) -> DataFrame:
    """hits with bot_family, bot_class, bot_name. Patterns run over the distinct agents, which are few: up to `most` of them are
    broadcast, so hits aren't shuffled by the few agents; where there are more, each hit is classified in place."""
    agents = [r[0] for r in hits.select(ua).filter(F.col(ua).isNotNull()).distinct().limit(most + 1).collect()]
    if len(agents) > most:
        return _classified(hits, ua)
    table = hits.sparkSession.createDataFrame([(a,) for a in sorted(agents)], f"`{ua}` string")
    # `most` rows at most, worked out here, so that the plan over the hits holds no patterns.
    known = hits.sparkSession.createDataFrame(_classified(table, ua).collect(), f"`{ua}` string, bot_family string, bot_class string, bot_name string")
    return hits.join(F.broadcast(known), ua, "left")
