"""Parameters of collection, roll-up and wording."""

# fixed values
BUCKETS = {"negativas": (0.5, 1.0, 1.5, 2.0, 2.5), "medianas": (3.0, 3.5), "positivas": (4.0, 4.5, 5.0)}
TARGETS = {"negativas": 50, "medianas": 20, "positivas": 30}
QUOTA_PER_LEVEL = 10
FLOOR_PER_BUCKET = 3
LENGTH_CASCADE = (150, 50, 0)
MAX_PAGES = 6
MAX_THEMES = 6
NULL_EDIT_SIMILARITY = 0.97
SPOILER_PLACEHOLDER = "This review may contain spoilers. I can handle the truth."
SITE = "https://films.example"
DISCLAIMER_QUOTAS = "grupos de 50 · 20 · 30 reviews são cotas de coleta — não a proporção real das opiniões"
DISCLAIMER_SHARES = "análise em profundidade igual por grupo (50·20·30 reviews); o peso real de cada faixa está indicado em cada grupo"
EDIT_RETRIES = 3

#: Rows of a review page.
PAGE_ROWS = 12
LEVELS = tuple(x for levels in BUCKETS.values() for x in levels)
