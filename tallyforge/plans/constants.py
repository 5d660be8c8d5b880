"""Fixed values of the synthetic mart: dimension rows, metric definitions, year anchors, shares and rates.

They must equal the published ones for results to agree.
"""

from __future__ import annotations

BRANDS = [
    (1, "Perodua", "national"), (2, "Proton", "national"), (3, "Honda", "non_national"), (4, "Toyota", "non_national"),
    (5, "Mazda", "non_national"), (6, "BYD", "non_national"), (7, "Chery", "non_national"), (8, "Others", "non_national"),
]
MODELS = [
    (1, 1, "Bezza", "sedan", "ice", "A", 0.28), (2, 1, "Myvi", "hatch", "ice", "B", 0.26), (3, 1, "Axia", "hatch", "ice", "A", 0.18),
    (4, 1, "Ativa", "suv", "ice", "B", 0.16), (5, 1, "Alza", "mpv", "ice", "B", 0.12), (6, 2, "Saga", "sedan", "ice", "A", 0.30),
    (7, 2, "X50", "suv", "ice", "B", 0.24), (8, 2, "X70", "suv", "ice", "C", 0.18), (9, 2, "S70", "sedan", "ice", "B", 0.16),
    (10, 2, "e.MAS 5", "suv", "ev", "B", 0.12), (11, 3, "City", "sedan", "ice", "B", 0.34), (12, 3, "Civic", "sedan", "ice", "C", 0.22),
    (13, 3, "HR-V", "suv", "ice", "C", 0.28), (14, 3, "WR-V", "suv", "ice", "B", 0.16), (15, 4, "Vios", "sedan", "ice", "B", 0.32),
    (16, 4, "Yaris", "hatch", "ice", "B", 0.18), (17, 4, "Corolla Cross", "suv", "hybrid", "C", 0.24), (18, 4, "Hilux", "pickup", "ice", "C", 0.26),
    (19, 5, "CX-5", "suv", "ice", "C", 0.62), (20, 5, "Mazda3", "sedan", "ice", "C", 0.38), (21, 6, "Atto 3", "suv", "ev", "C", 0.70),
    (22, 6, "Seal", "sedan", "ev", "C", 0.30), (23, 7, "Tiggo 8", "suv", "ice", "C", 0.55), (24, 7, "Omoda 5", "suv", "ice", "B", 0.45),
    (25, 8, "Other models", "mix", "ice", "mix", 1.0),
]
#: Order in which a brand's models take left-over units when fractions tie.
MODEL_ORDER = {13: 1, 12: 2, 18: 1, 17: 2, 16: 3, 11: 0, 14: 3, 15: 0}
REGIONS = [
    (1, "Klang Valley", "巴生谷", 0.38), (2, "Johor", "柔佛", 0.14), (3, "Penang", "槟城", 0.08), (4, "Perak", "霹雳", 0.07),
    (5, "Sabah", "沙巴", 0.06), (6, "Sarawak", "砂拉越", 0.06), (7, "Others", "其他州属", 0.21),
]
YEAR_TOTALS = {2024: 816747, 2025: 820752}
BRAND_YEAR = {
    2024: {"Perodua": 358102, "Proton": 147587, "Honda": 81699, "Toyota": 71514, "Mazda": 14464, "BYD": 8000, "Chery": 9000},
    2025: {"Perodua": 359904, "Proton": 151564, "Honda": 72301, "Toyota": 70352, "Mazda": 9277, "BYD": 14407, "Chery": 15300},
}
MONTH_WEIGHTS = {
    2024: [0.078, 0.075, 0.080, 0.079, 0.082, 0.081, 0.083, 0.082, 0.084, 0.085, 0.086, 0.105],
    2025: [0.076, 0.074, 0.079, 0.078, 0.081, 0.080, 0.082, 0.081, 0.083, 0.086, 0.089, 0.111],
}
SAME_MONTH_RATE = {"Perodua": 0.88, "Proton": 0.86, "Honda": 0.84, "Toyota": 0.74, "Mazda": 0.78, "BYD": 0.80, "Chery": 0.64, "Others": 0.75}
DEFAULT_RATE, QUARTER_END = 0.78, 0.90
REGION_BUMP, OTHER_BUMP = {1: 1.05, 5: 0.92, 6: 0.92}, 0.98
LEGACY_BUMP, OTHER_LEGACY_BUMP, LEGACY_DECEMBER_2025 = {1: 1.04, 5: 0.93, 6: 0.93}, 0.98, 0.96
METRICS = {
    "tiv": ("TIV / 批发销量", "协会口径批发（TIV-style）。问「销量/卖得好」且未指定上牌时，产品应停下来问人，不默认。", "year, month, brand/model/region"),
    "registration": ("上牌 / 注册量", "JPJ 上牌风格演示列。与 TIV 不是同一口径：同月同车型允许不一致。", "year, month, brand/model/region"),
    "share": ("份额", "分子分母必须同一指标、同一时间、同一筛选。默认份额用 TIV。", "same as numerator"),
    "yoy": ("同比", "(本期 − 去年同期) / 去年同期。去年同期为 0 则不出同比。", "year-month vs year-12"),
    "national": ("国产车", "仅 Perodua + Proton。不是「全部马来西亚生产」。", "brand.origin = national"),
}
METRIC_OWNER, METRIC_VERSION = "demo.metrics", "2026.08.1"
