"""The tables, metrics and documents of the mart's lineage, and what feeds what."""

from __future__ import annotations

LAYERS = ("ods", "dim", "dwd", "ads", "metric", "doc")
#: object, kind, table, grain, version, note, aliases
NODES = [
    ("ods.brand_year_anchor", "table", "ods_brand_year_anchor", "year, brand", "2026.08.2", "公开报道的品牌年 TIV 锚。Chery / Others 是演示残差。不是 MAA 原始明细。", ["ods", "年锚", "公开报道", "820752", "锚"]),
    ("dim.brand", "table", "dim_brand", "brand", "2026.08.2", "品牌维。origin = national 仅 Perodua、Proton。", ["品牌", "国产", "origin"]),
    ("dim.model", "table", "dim_model", "model", "2026.08.2", "车型维。能源 ice / hybrid / ev。", ["车型", "能源", "ev"]),
    ("dim.region", "table", "dim_region", "region", "2026.08.2", "区域维：巴生谷 / 柔佛 / 槟城 / 霹雳 / 沙巴 / 砂拉越 / 其他。", ["区域", "州", "巴生谷"]),
    ("dwd.fact_month", "table", "fact_month", "year, month, model, region", "2026.08.2", "明细事实表。tiv_units 与 registration_units 分列。月×区×车型是种子拆分。", ["dwd", "明细", "fact_month", "哪张表", "从哪来", "溯源"]),
    ("ads.brand_year", "table", "ads_brand_year", "year, brand", "2026.08.2", "品牌年汇总。全年、无区域、无能源筛选时问品牌合计走这张表。", ["ads", "汇总", "全年合计"]),
    ("ads.brand_month", "table", "ads_brand_month", "year, month, brand", "2026.08.2", "品牌月汇总。带车型或区域筛选时仍走 DWD。", ["ads", "各月"]),
    ("metric.tiv", "metric", "fact_month", "year, month, brand/model/region", "2026.08.1", "协会口径批发（TIV-style）。列 tiv_units。问「销量」且未指定时不停在这套数上猜。", ["tiv", "批发", "协会", "协会口径"]),
    ("metric.registration", "metric", "fact_month", "year, month, brand/model/region", "2026.08.1", "上牌 / 注册量。列 registration_units。与 TIV 允许对不上。", ["上牌", "注册", "jpj", "registration"]),
    ("metric.share", "metric", None, "same as numerator", "2026.08.1", "份额。分子分母必须同一指标、同一时间、同一筛选。", ["份额", "市占", "share"]),
    ("metric.yoy", "metric", None, "year vs year-1", "2026.08.1", "同比。(本期 − 去年同期) / 去年同期。去年为 0 则空。", ["同比", "yoy"]),
    ("metric.national", "metric", "dim_brand", "brand.origin = national", "2026.08.1", "国产车仅 Perodua + Proton。不是「马来西亚生产的都算」。", ["国产", "national", "宝腾"]),
    ("doc.口径", "document", None, None, "2026.08.2", "docs/口径.md。口径问句检索这篇，不走 SQL。", ["口径", "owner", "版本", "定义"]),
    ("doc.分层", "document", None, None, "2026.08.2", "演示分层 ODS / DIM / DWD / ADS。不是企业 Atlas。", ["分层", "数仓", "血缘", "几层"]),
]
#: source, destination, transform, grain
EDGES = [
    ("ods.brand_year_anchor", "dwd.fact_month", "年合计按固定种子拆到月×车型×区域；上牌列再按区域偏置。演示拆分，不是协会明细。", "year,brand → year,month,model,region"),
    ("dim.brand", "dwd.fact_month", "经 dim_model.brand_id 关联。", "brand_id"),
    ("dim.model", "dwd.fact_month", "fact_month.model_id = dim_model.model_id", "model_id"),
    ("dim.region", "dwd.fact_month", "fact_month.region_id = dim_region.region_id", "region_id"),
    ("dwd.fact_month", "ads.brand_year", "SUM(tiv_units), SUM(registration_units) GROUP BY year, brand_id", "year, brand"),
    ("dwd.fact_month", "ads.brand_month", "SUM GROUP BY year, month, brand_id", "year, month, brand"),
    ("dwd.fact_month", "metric.tiv", "列 tiv_units", "same as fact"),
    ("ads.brand_year", "metric.tiv", "全年品牌合计可走汇总，避免扫月×区×车型。", "year, brand"),
    ("dwd.fact_month", "metric.registration", "列 registration_units", "same as fact"),
    ("ads.brand_year", "metric.registration", "全年品牌上牌合计可走汇总。", "year, brand"),
    ("metric.tiv", "metric.share", "份额分子分母同一指标。选中 TIV 时用 tiv_units。", "same filter"),
    ("metric.registration", "metric.share", "选中上牌时用 registration_units。", "same filter"),
    ("metric.tiv", "metric.yoy", "(本年 − 去年) / 去年，同一指标。", "year vs year-1"),
    ("metric.registration", "metric.yoy", "(本年 − 去年) / 去年，同一指标。", "year vs year-1"),
    ("dim.brand", "metric.national", "origin = national（Perodua、Proton）", "brand"),
    ("doc.口径", "metric.tiv", "口径文档约束 TIV 定义与 HITL。", None),
    ("doc.口径", "metric.registration", "口径文档约束上牌定义。", None),
    ("doc.分层", "ods.brand_year_anchor", "分层说明指向 ODS 年锚。", None),
    ("doc.分层", "dwd.fact_month", "分层说明指向 DWD 明细。", None),
    ("doc.分层", "ads.brand_year", "分层说明指向 ADS 汇总。", None),
]
METRIC_ALIASES = {
    "tiv": ["tiv", "批发", "协会", "协会口径"], "registration": ["上牌", "注册", "jpj", "registration"], "share": ["份额", "市占", "share", "怎么算"],
    "yoy": ["同比", "yoy"], "national": ["国产", "national", "宝腾"],
}
#: Words of a question that name objects, in order.
FOCUS = [
    (r"上牌|注册|jpj|registration", ["metric.registration"]), (r"tiv|批发|协会", ["metric.tiv"]), (r"份额|市占|share", ["metric.share"]), (r"同比|yoy", ["metric.yoy"]),
    (r"国产|national", ["metric.national"]), (r"数仓|分层|血缘|ods|dwd|ads|从哪|哪张表|溯源|几层", ["dwd.fact_month", "ods.brand_year_anchor", "ads.brand_year", "doc.分层"]),
    (r"口径|owner|版本|定义", ["doc.口径"]),
]
STOP_WORDS = (
    "的 了 是 在 和 与 或 及 把 被 对 从 到 有 没有 请 问 什么 怎么 如何 哪 这个 那个 a an the of to for in on is are".split()
)

# The name of a document's opening, headings about layers, and further names of headings.
PREAMBLE = "口径"
LAYER_SECTIONS = ("分层", "血缘")
SECTION_ALIASES = {
    "口径": ["口径", "owner", "版本", "demo.metrics"],
    "分层": ["分层", "数仓", "ods", "dwd", "ads", "血缘", "溯源", "几层"],
    "血缘": ["分层", "数仓", "ods", "dwd", "ads", "血缘", "溯源", "几层"],
    "tiv": ["tiv", "批发", "协会"],
    "registration": ["上牌", "注册", "jpj"],
    "share": ["份额", "市占"],
    "national": ["国产"],
}
