"""Fixed values of the payout-sheet domain: keyword patterns, defaults and tables."""

# Header patterns by semantic type; the order is the claim priority.
COLUMN_KEYWORDS = {
    "name": r"(?i)姓名|户名|名称|人员|收款人|员工|name|person",
    "idCard": r"(?i)身份证|身份证号|身份证号码|id\s*card|idcard|证件号",
    "phone": r"(?i)电话|phone|手机|mobile|联系电话",
    "bankName": r"(?i)开户行|开户银行|银行名称|bank\s*name",
    "bankCard": r"(?i)银行|bank|卡号|bankcard|账号|账户|个人银行卡号",
    "amount": r"(?i)金额|amount|收入|income|报酬|pay|税前金额|税前收入|税后收入|应发金额|实发金额|计划发放收入|发放金额|付款金额|应发金额\(含税\)|应发金额（含税）",
    "gender": r"(?i)性别|gender|sex",
    "location": r"(?i)开户地|开户所属地|银行所属地|税源地",
    "note": r"(?i)备注|note|说明|remark",
    "shangSheId": r"(?i)商社编号|商社代码|商户编号",
    "clientName": r"(?i)客户名称|公司名称|委托方名称?|甲方名称?",
    "taxId": r"(?i)纳税人识别号|统一信用代码|统一社会信用代码|税号|信用代码",
}
# Display labels of the types.
TYPE_LABELS = {
    "name": "姓名", "idCard": "身份证", "phone": "手机号", "bankName": "开户银行", "bankCard": "银行卡号", "amount": "税前金额",
    "amountTotal": "合计金额（仅核对，不导出）", "gender": "性别", "location": "开户地/税源地", "note": "备注", "shangSheId": "商社编号",
    "clientName": "客户名称", "taxId": "纳税人识别号",
}
# Patterns of table detection.
HEADER_WORDS = r"(?i)月份|month|收入|income|金额|amount|姓名|name|身份证|电话|phone|手机|银行|bank|卡号|性别|gender|开户|账号|备注|note|出错|平台|商社|任务|税源|工种|付款|收款|商户|订单|发放|应发|实发|户名"
SEQUENCE_HEADER = r"序号|编号|^#\z"
TOTAL_ROW = r"^(合计|总计|汇总|小计|累计)"
FEE_LABEL = r"费|平台|服务|合计|小计|总计|汇总|累计|税率|税点|费率|金额|账号|银行|开户|手机|电话|性别|备注|说明|序号|编号|开票|支付|社保|公积金|保险|个税|报酬|收入|商户|订单"
NOT_A_NAME_COLUMN = r"开户地|税源地|地址|地区|区域|城市|类型|方式|项目"
FEE_PREFIX = r"^(合计|总计|小计|累计|汇总|平台|服务费|手续费|费率|税率|金额|开票)"
CARD_HINT = r"(?i)卡|账号|帐号|账户|card"
LOCATION_HEADER = r"开户地|开户所属地|银行所属地|税源地"
AMOUNT_EXCLUDED = r"序号|编号|方式|类型|选择|状态|税源地|开户|账号|账户|手机号|电话|身份证|证件|银行|备注|说明|业务|减除|扣除|速算|核定|预扣(?!前)|免税|服务费|个税"
MULTI_AMOUNT_EXCLUDED = AMOUNT_EXCLUDED + r"|数量|件数|笔数|人数|天数"
AMOUNT_TIERS = ((12, r"(?i)税前金额|税前收入"), (9, r"(?i)计划发放收入|应发金额|实发金额|客户支付合计|付款金额"), (6, r"(?i)金额|amount|收入额|合计金额|应付金额"))
PEN_HEADER = r"^第\s*(?:[一二三四五六七八九十百]+|\d+)\s*笔\z"
MONTH_HEADER = r"^(?:0?[1-9]|1[0-2])\s*月\z"
SHEET_NOT_SELECTED = r"(?i)(汇总|总表|说明|模板|图表|透视|summary|chart|cover|封面|配置表|任务清单)"
SHEET_BONUS, SHEET_PENALTY = r"(?i)(费用明细|工资|报酬|劳务|发放|明细)", r"(?i)(汇总|总表|配置|任务)"
# The name cleaner's guards.
ORG_SUFFIX = r"(公司|银行|支行|分行|商行|商社|营业部|营业室|事务所|工作室|服务部|经营部|中心|店|厂|院|所|队|站|校)\z"
# Names of the ways a client is found, exact names first, and date patterns of a sheet's head.
NAME_MATCHES = ("全称精确", "简称精确", "模糊匹配")
TAX_MATCH = "税号精确"
YEAR_HINT = r"(20\d{2})"
MONTH_HINTS = (r"(?:^|[^\d])(20\d{2}\s*年\s*\d{1,2}\s*月)", r"(?:^|[^\d])(20\d{2}[-/.]\d{1,2})")
# Weights and check characters of an 18-digit id.
ID_WEIGHTS = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)
ID_CHECKS = "10X98765432"
# Default reference data.
TAX_SOURCES = ("0001.湖南", "0002.海南", "0003.河南", "0004.安徽", "0005.信宜", "0006.湖北", "0007.天津")
PLATFORMS = (
    "278.甲乙科技", "283.丙丁工场", "288.戊己客（灵活用工）6.2%", "290.庚辛云", "294.湖南清源", "295.岳西众才", "298.戊己客（企和推荐）7.1%", "349.河南雅文", "356.国联信宜",
    "367.安徽优文莱（培训业务）", "375.湖南合用工", "376.戊己客（冠华系列）6.42%+50", "378.安徽薪账通", "379.咸宁合用工6.1%", "397.戊己客平台（自营业务）7.5%", "409.天津税地（身边云）5.6%",
    "451.戊己客（7.9%）", "453.戊己客（7.1%）", "454.戊己客（8.1%）", "455.戊己客（8.7%）", "456.戊己客（9.6%）", "461.戊己客（7.7%）", "462.戊己客（7.5%）", "468.潮涌（8.2%）",
    "481.星薪平台（6.1%）", "484.江西合用工（6.1%）", "485.小规模纳税企业结算（6.67%）", "486.河南茂丰源（5.4%）",
)
SIGN_ENTITIES = (
    ("佛山云杉", ("佛山", "甲乙")), ("广州南沙云杉", ("南沙",)), ("广州国联", ("国联",)),
    ("广州云杉", ("广州", "丙丁")), ("深圳云杉", ("深圳", "梓合")), ("东莞云杉", ("东莞", "梓才")),
)
PLATFORM_TAX = (
    ("天津", "0007.天津"), ("身边云", "0007.天津"), ("戊己客", "0007.天津"), ("河南", "0003.河南"), ("茂丰源", "0003.河南"), ("雅文", "0003.河南"),
    ("安徽", "0004.安徽"), ("岳西", "0004.安徽"), ("优文莱", "0004.安徽"), ("薪账通", "0004.安徽"), ("信宜", "0005.信宜"), ("国联", "0005.信宜"),
    ("湖北", "0006.湖北"), ("咸宁", "0006.湖北"), ("海南", "0002.海南"), ("湖南", "0001.湖南"), ("合用工", "0001.湖南"), ("清源", "0001.湖南"), ("甲乙", "0001.湖南"),
)
# Pinyin initials, exceptions and the first character of each letter in collation order.
PINYIN_SPECIALS = {"晟": "S", "联": "L", "数": "S", "码": "M", "博": "B", "跃": "Y", "重": "C", "长": "C", "厦": "X", "曾": "Z", "单": "S"}
PINYIN_BOUNDARIES = (
    ("A", "阿"), ("B", "八"), ("C", "嚓"), ("D", "咑"), ("E", "妸"), ("F", "发"), ("G", "旮"), ("H", "哈"), ("J", "讥"), ("K", "咖"), ("L", "垃"), ("M", "妈"),
    ("N", "拿"), ("O", "哦"), ("P", "啪"), ("Q", "七"), ("R", "呥"), ("S", "仨"), ("T", "他"), ("W", "哇"), ("X", "夕"), ("Y", "丫"), ("Z", "匝"),
)
CLIENT_SHEET_HEADERS = ("商社编号", "商社简称", "商社全称", "一级业务类型", "二级业务类型", "纳税人识别号", "签约费率", "签约主体", "任务名称", "服务内容")
# Work types, tried in this order.
WORK_TYPES = (
    ("保洁", "保洁|清洁|清扫|打扫|清洗|家政|卫生"), ("搬运", "搬运|装卸|分拣|理货|仓储|打包|包装|配送|快递|物流"), ("司机", "司机|驾驶|代驾|开车|车辆|运输"),
    ("客服", "客服|客户服务|呼叫|回访|咨询|售后"), ("销售", "销售|促销|推广|导购|营销|业务拓展"), ("技术", "技术|开发|软件|系统|运维|测试|信息|数据|网络|设计"),
    ("培训", "培训|讲师|授课|教学|辅导|教练"), ("翻译", "翻译|口译|笔译"), ("摄影", "摄影|摄像|拍摄|剪辑|视频|直播"), ("安保", "安保|保安|秩序|巡逻|门卫"),
    ("餐饮", "餐饮|厨师|后厨|配餐|服务员|洗碗"), ("文员", "文员|行政|助理|录入|文案|资料整理"), ("安装维修", "安装|维修|维护|检修|修理|装配"),
)
# Provinces of bank branches. Cities are a parameter, in the order in which they are tried.
PROVINCES = (
    "河北", "山西", "辽宁", "吉林", "黑龙江", "江苏", "浙江", "安徽", "福建", "江西", "山东", "河南", "湖北", "湖南", "广东", "海南", "四川", "贵州", "云南", "陕西", "甘肃", "青海", "台湾", "内蒙古", "广西", "西藏", "宁夏", "新疆",
)
# Border lines read as characters, and quotes and noise at the edges of recognised cells.
BORDER_PIPES = r"[\x{007C}\x{FF5C}\x{2502}\x{2503}\x{2506}\x{2223}\x{01C0}]"
EDGE_QUOTES = "\\s\"'“”‘’「『」』"
EDGE_NOISE = "\\s.,()（）\\[\\]【】《》<>＞＜“”‘’\"'「『」』·、；;:：！!？?～~—–_+"
# Verbs, kinds and services in task names, words of bank names and of companies.
TASK_VERB = "^(提供|从事|完成|开展)"
TASK_KIND = r"(类)?(服务|工作|任务|人员|岗位)\z"
NAMED_SERVICE = r"(?:提供|从事|完成|开展)([^，。,；;\s]{2,12}?)(?:服务|工作|任务)"
BANK_WORDS = "中国|股份有限公司|有限责任公司|银行|信用社|农商行|支行|分行|营业部|营业厅|储蓄所|网点"
ENTITY_WORDS = "有限公司|人力资源|服务|广州|佛山"
# Characters that recognition confuses in numbers, with what they stand for.
MISREAD = ("日OoＯLlI｜&＆。，．,", "00001111......")
# Target templates: headers in order, and the type that fills each.
TEMPLATE_HEADERS = {
    "yidao": ("姓名", "身份证", "手机号", "开户银行", "银行卡号", "税前金额"),
    "shenbianyun": ("商户订单号（非必填）", "任务ID（条件必填）", "收款人姓名（必填）", "身份证号（必填）", "收款账号（条件必填）", "付款金额（元，必填）", "手机号（必填）", "备注（非必填）", "自定义备注（非必填）"),
    "youyi": ("出错信息", "平台", "商社编号", "姓名", "身份证号码", "性别", "任务清单", "税源地", "工种", "手机号码", "账号", "银行名称", "银行所属地", "税前金额", "个税金额", "商业保险", "备注"),
}
TEMPLATE_FIELDS = {
    "yidao": (("name", "姓名"), ("idCard", "身份证"), ("phone", "手机号"), ("bankName", "开户银行"), ("bankCard", "银行卡号"), ("amount", "税前金额")),
    "shenbianyun": (("name", "收款人姓名（必填）"), ("idCard", "身份证号（必填）"), ("bankCard", "收款账号（条件必填）"), ("amount", "付款金额（元，必填）"), ("phone", "手机号（必填）"), ("note", "备注（非必填）")),
    "youyi": (("name", "姓名"), ("idCard", "身份证号码"), ("gender", "性别"), ("phone", "手机号码"), ("bankCard", "账号"), ("bankName", "银行名称"), ("location", "银行所属地"), ("amount", "税前金额"), ("note", "备注"), ("shangSheId", "商社编号")),
}
# What a cell of a number may hold, misread characters included.
DIGIT_CELL = r"^[0-9\s.,，。&＆OoLlI｜日．]+\z"
# Display names of the templates in file names, and their sheets.
TEMPLATE_NAMES = {"yidao": "移步到岗", "shenbianyun": "身边云", "youyi": "本公司", "custom": "自定义"}
SHEET_NAMES = {"yidao": "智能模板", "shenbianyun": "Sheet1", "youyi": "费用明细", "custom": "数据"}
CONFIG_SHEET, TASK_SHEET, CLIENT_SHEET, ENTITY_SHEET, PLATFORM_SHEET = "配置表", "任务清单", "知识库", "签约主体映射", "平台税源地映射"
BATCH_TEMPLATES = ("yidao", "shenbianyun")
# The batch payment sheet's first rows, number formats and column widths.
PAYMENT_NOTE = """单批次最大支持12000条订单。
商户订单号纯数字并且唯一，禁止重复。
多任务模式时任务ID必填（单次最多50个任务），单任务模式时不可填任务ID。
收款账号需要与所选收款方式对应匹配，银行卡方式对应个人银行卡号、支付宝方式对应支付宝号、微信方式对应OpenID。
付款金额保留两位小数，四舍五入。
备注字段最大限制20字，银行备注展示限制具体以银行为准。
付款文件名称或备注存在以下字段会导致文件上传失败：工资、薪酬、提现、薪、补贴、分红、奖金、返现、劳务费、分润、备用金、¥、$
银行卡号建议使用一类户，如使用二类户日限额导致交易退汇，需T+8个工作日退回"""
PAYMENT_BATCH_LABEL = "商户批次号（非必填）"
PAYMENT_AMOUNT = "付款金额（元，必填）"
PLAIN_FORMAT, CURRENCY_FORMAT = "#,##0.00", "¥#,##0.00"
PAYMENT_WIDTHS = (22.6333333333333, 20.6333333333333, 22.6333333333333, 20.5, 27.5, 22.6333333333333, 16, 16, 22.6333333333333)
# Labels of a client's name and tax id in the cells of a sheet.
CLIENT_LABEL = "客户名称|公司名称|委托方|甲方"
TAX_LABEL = "统一信用代码|纳税人识别号|统一社会信用代码|税号|信用代码"
