"""Fixed values.

Word lists, lookup tables, constants, patterns and message formats below are
given by the rules themselves; results are only right when they match exactly.
Nothing here is logic.
"""

from __future__ import annotations

# --- fixed values: character classes and marks -----------------------------

CJK = r"一-鿿"

MIXED_MARKS = {",": "，", ".": "。", "?": "？", "!": "！", ":": "：", ";": "；"}

REPEATED_MARKS = ["。。", "！！", "？？", "，，", "；；", "：：", "!!", "??", ",,"]

BRACKET_PAIRS = ["（）", "()", "【】", "[]", "《》", "{}", "「」", "『』"]

FULLWIDTH_DIGITS = "０１２３４５６７８９"

SENTENCE_ENDS = "。！？；:："

# Single characters that may legally appear doubled.
VALID_DOUBLES = (
    "人天日月年分种样次家各个件位条层片串"
    "爸妈哥姐弟妹爷奶叔姑舅姨宝乖娃咪"
    "红绿黄蓝黑白灰高矮胖瘦长短大小多少"
    "快慢好坏美丑干湿冷热深浅闪亮暗晃"
    "看说想听走跑笑哭睡纷茫蒙沉往熊悄隐默"
    "刚常偏偶每仅单独仍依"
)

# Characters that end one word and start the next.
WORD_EDGE_CHARS = (
    "海洋湖江河湾陆岸岛礁面表底层端侧边角心中间"
    "数量率度力场流压能温物学术理性体态型式法"
    "论制观境状势系素质点线路道图文字语词"
    "波热声光电磁动静化"
)

ADVERBS = [
    "认真", "快速", "慢慢", "悄悄", "飞快", "高效", "精准", "频繁", "持续", "仔细", "仓促", "温和", "激烈", "平静", "急速", "缓慢", "小心",
    "大胆", "直接", "间接", "主动", "被动", "自愿", "被迫", "努力", "懒散",
]

PREDICATE_VERBS = [
    "说", "做", "看", "听", "走", "跑", "写", "读", "学", "想", "打", "吃", "喝", "睡", "坐", "站", "来", "去", "给", "让", "使",
    "用", "找", "等", "问", "答", "叫", "帮", "带", "送", "发生", "进行", "产生", "出现", "存在", "提高", "增加", "减少", "改变", "影响",
    "推动", "促进", "实现", "完成", "开始", "结束", "发展", "建设", "管理", "分析", "研究", "设计", "规划", "组织", "匹配", "拟合", "计算",
    "流动", "循环", "变化", "上升", "下降",
]

# --- fixed values: built-in word corrections (wrong, right, note) ----------

COMMON_WORD_FIXES = [
    ("帐号", "账号", "账户的'账'应是'账'"),
    ("帐户", "账户", "账户的'账'应是'账'"),
    ("帐单", "账单", "账单的'账'应是'账'"),
    ("登录帐号", "登录账号", ""),
    ("做为", "作为", "'做'应为'作'"),
    ("既使", "即使", "'既'应为'即'"),
    ("既便", "即便", "'既'应为'即'"),
    ("按装", "安装", "'按'应为'安'"),
    ("报歉", "抱歉", "'报'应为'抱'"),
    ("必竟", "毕竟", "'必'应为'毕'"),
    ("决对", "绝对", "'决'应为'绝'"),
    ("决大部分", "绝大部分", "'决'应为'绝'"),
    ("做业", "作业", "'做'应为'作'"),
    ("象样", "像样", "'象'应为'像'"),
    ("幅射", "辐射", "'幅'应为'辐'"),
    ("象是", "像是", "'象'应为'像'"),
    ("迷语", "谜语", "'迷'应为'谜'"),
    ("兰色", "蓝色", "'兰'应为'蓝'"),
    ("蓝球", "篮球", "'蓝'应为'篮'"),
    ("作饭", "做饭", "'作'应为'做'"),
    ("带帽", "戴帽", "'带'应为'戴'"),
    ("带花", "戴花", "'带'应为'戴'"),
    ("复盖", "覆盖", "'复'应为'覆'"),
    ("简炼", "简练", "'炼'应为'练'"),
    ("锻练", "锻炼", "'练'应为'炼'"),
    ("立生", "产生", "语境中常见误写，通常应为'产生'"),
    ("他门", "他们", "常见形近误写"),
    ("磨厉", "磨砺", "'厉'应为'砺'"),
    ("冒然", "贸然", "'冒'应为'贸'"),
    ("脉博", "脉搏", "'博'应为'搏'"),
    ("膨涨", "膨胀", "'涨'应为'胀'"),
    ("园满", "圆满", "'园'应为'圆'"),
    ("火中取粟", "火中取栗", "'粟'应为'栗'"),
    ("针贬", "针砭", "'贬'应为'砭'"),
    ("频临", "濒临", "'频'应为'濒'"),
    ("座标", "坐标", "'座'应为'坐'"),
    ("赋与", "赋予", "'与'应为'予'"),
    ("密诀", "秘诀", "'密'应为'秘'"),
]

IDIOM_FIXES = [
    ("爱不失手", "爱不释手", "'失'应为'释'"),
    ("按步就班", "按部就班", "'步'应为'部'"),
    ("拔山涉水", "跋山涉水", "'拔'应为'跋'"),
    ("百无聊懒", "百无聊赖", "'懒'应为'赖'"),
    ("搬门弄斧", "班门弄斧", "'搬'应为'班'"),
    ("半途而费", "半途而废", "'费'应为'废'"),
    ("饱经苍桑", "饱经沧桑", "'苍'应为'沧'"),
    ("变本加利", "变本加厉", "'利'应为'厉'"),
    ("不记其数", "不计其数", "'记'应为'计'"),
    ("不径而走", "不胫而走", "'径'应为'胫'"),
    ("不落巢臼", "不落窠臼", "'巢'应为'窠'"),
    ("残无人道", "惨无人道", "'残'应为'惨'"),
    ("操胜卷", "操胜券", "'卷'应为'券'"),
    ("侧隐之心", "恻隐之心", "'侧'应为'恻'"),
    ("察颜观色", "察言观色", "'颜'应为'言'"),
    ("出奇不意", "出其不意", "'奇'应为'其'"),
    ("穿流不息", "川流不息", "'穿'应为'川'"),
    ("粗制烂造", "粗制滥造", "'烂'应为'滥'"),
    ("当人不让", "当仁不让", "'人'应为'仁'"),
    ("鬼计多端", "诡计多端", "'鬼'应为'诡'"),
    ("轰堂大笑", "哄堂大笑", "'轰'应为'哄'"),
    ("记忆尤新", "记忆犹新", "'尤'应为'犹'"),
    ("金壁辉煌", "金碧辉煌", "'壁'应为'碧'"),
    ("刻勤刻俭", "克勤克俭", "'刻'应为'克'"),
    ("烂芋充数", "滥竽充数", "'烂芋'应为'滥竽'"),
    ("厉厉在目", "历历在目", "'厉'应为'历'"),
    ("美仑美奂", "美轮美奂", "'仑'应为'轮'"),
    ("名符其实", "名副其实", "'符'应为'副'"),
    ("默守成规", "墨守成规", "'默'应为'墨'"),
    ("旁证博引", "旁征博引", "'证'应为'征'"),
    ("迫不急待", "迫不及待", "'急'应为'及'"),
    ("披星带月", "披星戴月", "'带'应为'戴'"),
    ("破斧沉舟", "破釜沉舟", "'斧'应为'釜'"),
    ("巧夺天公", "巧夺天工", "'公'应为'工'"),
    ("磬竹难书", "罄竹难书", "'磬'应为'罄'"),
    ("趋之若骛", "趋之若鹜", "'骛'应为'鹜'"),
    ("声名雀起", "声名鹊起", "'雀'应为'鹊'"),
    ("谈笑风声", "谈笑风生", "'声'应为'生'"),
    ("提心掉胆", "提心吊胆", "'掉'应为'吊'"),
    ("挺而走险", "铤而走险", "'挺'应为'铤'"),
    ("文过是非", "文过饰非", "'是'应为'饰'"),
    ("相儒以沫", "相濡以沫", "'儒'应为'濡'"),
    ("消声匿迹", "销声匿迹", "'消'应为'销'"),
    ("心无旁鹜", "心无旁骛", "'鹜'应为'骛'"),
    ("虚无飘渺", "虚无缥缈", "'飘'应为'缥'"),
    ("再接再励", "再接再厉", "'励'应为'厉'"),
    ("走头无路", "走投无路", "'头'应为'投'"),
    ("自曝自弃", "自暴自弃", "'曝'应为'暴'"),
]

# --- fixed values: consistency ---------------------------------------------

NUMBER_PATTERN = r"(?U)(\d[\d,，]*\d|\d)(?:\.\d+)?"

DATE_PATTERNS = [
    r"(?U)(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日",
    r"(?U)(\d{4})[/-](\d{1,2})[/-](\d{1,2})",
    r"(?U)(\d{4})\.(\d{1,2})\.(\d{1,2})",
]

ORG_NAME_PATTERN = (
    r"[一-鿿]{2,4}(?:公司|集团|大学|学院|研究院|研究所|医院|政府|部门|委员会|中心)"
)

TERM_FORMS = {
    "人工智能": ["AI", "artificial intelligence"],
    "机器学习": ["ML", "machine learning"],
    "深度学习": ["DL", "deep learning"],
    "神经网络": ["NN", "neural network"],
    "卷积神经网络": ["CNN", "convolutional neural network"],
    "循环神经网络": ["RNN", "recurrent neural network"],
    "自然语言处理": ["NLP", "natural language processing"],
    "计算机视觉": ["CV", "computer vision"],
    "强化学习": ["RL", "reinforcement learning"],
    "生成对抗网络": ["GAN", "generative adversarial network"],
    "支持向量机": ["SVM", "support vector machine"],
    "主成分分析": ["PCA", "principal component analysis"],
    "逻辑回归": ["LR", "logistic regression"],
    "决策树": ["DT", "decision tree"],
    "随机森林": ["RF", "random forest"],
    "梯度提升": ["GBDT", "gradient boosting decision tree"],
    "长短期记忆": ["LSTM", "long short-term memory"],
    "Transformer": ["transformer", "注意力机制"],
    "大语言模型": ["LLM", "large language model"],
    "预训练模型": ["pre-trained model", "基础模型"],
}

UNIT_FORMS = {
    "米": ["m", "meter", "meters"],
    "千米": ["km", "kilometer", "kilometers", "公里"],
    "厘米": ["cm", "centimeter", "centimeters"],
    "毫米": ["mm", "millimeter", "millimeters"],
    "千克": ["kg", "kilogram", "kilograms", "公斤"],
    "克": ["g", "gram", "grams"],
    "吨": ["t", "ton", "tons"],
    "升": ["L", "l", "liter", "liters"],
    "毫升": ["mL", "ml", "milliliter", "milliliters"],
    "平方米": ["m²", "m2", "square meter"],
    "立方米": ["m³", "m3", "cubic meter"],
    "秒": ["s", "second", "seconds"],
    "分钟": ["min", "minute", "minutes"],
    "小时": ["h", "hour", "hours"],
    "天": ["d", "day", "days"],
    "年": ["y", "year", "years"],
    "摄氏度": ["°C", "℃", "Celsius"],
    "华氏度": ["°F", "Fahrenheit"],
    "开尔文": ["K", "Kelvin"],
    "帕斯卡": ["Pa", "pascal"],
    "牛顿": ["N", "newton"],
    "焦耳": ["J", "joule"],
    "瓦特": ["W", "watt"],
    "伏特": ["V", "volt"],
    "安培": ["A", "ampere"],
    "欧姆": ["Ω", "ohm"],
    "赫兹": ["Hz", "hertz"],
    "字节": ["B", "byte", "bytes"],
    "千字节": ["KB", "kB", "kilobyte"],
    "兆字节": ["MB", "megabyte"],
    "吉字节": ["GB", "gigabyte"],
    "太字节": ["TB", "terabyte"],
}

ONE_LETTER_UNITS = "mLltdshKNJWVABg"

# --- fixed values: logic ----------------------------------------------------

TURN_MARKERS = [
    "但是", "然而", "不过", "可是", "却", "相反",
]

OPPOSITES = [
    ("增加", "减少"), ("提高", "降低"), ("上升", "下降"), ("增长", "下降"),
    ("扩大", "缩小"), ("加强", "削弱"), ("支持", "反对"), ("正确", "错误"),
    ("成功", "失败"), ("有利", "不利"), ("积极", "消极"),
]

CAUSE_WORD = "因为"
RESULT_WORDS = [
    "所以", "因此", "导致",
]

YEAR_PATTERN = r"(?U)(\d{4})\s*年"
YEAR_MIN, YEAR_MAX = 1900, 2100

CONCLUSION_WORDS = [
    "结论", "总结", "总之", "综上", "由此可见", "结果表明",
]
DATA_WORDS = [
    "数据", "统计", "调查", "实验", "分析", "研究", "测试",
]

OPINION_WORDS = [
    "认为", "觉得", "主张", "提议", "建议", "应该", "必须", "务必", "显然", "毫无疑问", "显而易见", "可以肯定", "由此可见",
]
EVIDENCE_WORDS = [
    "数据表明", "研究显示", "实验证明", "据统计", "调查", "例如", "比如", "实例", "案例", "事实", "因为", "由于", "原因是", "鉴于", "基于",
]

IF_THEN = [
    ("如果", ["那么", "就", "则", "便"]),
    ("假如", ["那么", "就", "则"]),
    ("倘若", ["那么", "就", "则"]),
    ("只要", ["就"]),
    ("只有", ["才"]),
    ("除非", ["否则", "才"]),
    ("无论", ["都", "也"]),
    ("不管", ["都", "也"]),
]

COMPARE_WORDS = ["比", "相比", "相较于", "与...相比", "相对于", "更", "更加", "更为", "越发", "愈发"]
DIMENSION_PAIRS = [
    ("质量", "数量"), ("速度", "效率"), ("成本", "费用"),
    ("性能", "功能"), ("优点", "优势"), ("缺点", "不足"),
]

# --- fixed values: cross references ----------------------------------------

CN_NUMERALS = [
    "一", "二", "三", "四", "五", "六", "七", "八", "九", "十", "十一", "十二", "十三", "十四", "十五", "十六", "十七", "十八", "十九",
    "二十",
]

BIBLIOGRAPHY_HEADING = r"(?iU)参考文献|references?\b|bibliography"

TARGET_PATTERNS = {
    "figure": [r"(?U)^图\s*(\d+)[\-\.](\d+)\s*(.*)", r"(?U)^图\s*(\d+)\s*(.*)"],
    "table": [r"(?U)^表\s*(\d+)[\-\.](\d+)\s*(.*)", r"(?U)^表\s*(\d+)\s*(.*)"],
    "equation": [r"(?U)[(（]\s*(\d+)[\-\.](\d+)\s*[)）]\s*$"],
    "chapter": [r"(?U)^第([一二三四五六七八九十百零〇\d]+)章\s*(.*)$", r"(?U)^(\d+)\s*[\.、]\s*(?!\d)(.*)$"],
    "reference": [r"(?U)^\s*\[(\d+)\]\s*(.*)"],
}

POINT_PATTERNS = [
    ("figure", r"(?U)图\s*(\d+)[\-\.](\d+)"),
    ("figure", r"(?U)(?<!附)图\s*(\d+)(?![\-\.])"),
    ("table", r"(?U)表\s*(\d+)[\-\.](\d+)"),
    ("table", r"(?U)表\s*(\d+)(?![\-\.])"),
    ("equation", r"(?U)[（(]\s*(\d+)[\-\.](\d+)\s*[）)]"),
    ("equation", r"(?U)式\s*(\d+)[\-\.](\d+)"),
    ("equation", r"(?U)公式\s*(\d+)[\-\.](\d+)"),
    ("chapter", r"(?U)第([一二三四五六七八九十百\d]+)章"),
    ("chapter", r"(?U)(\d+)\.[\d\.]*\s*节"),
    ("reference", r"(?U)\[(\d+(?:\s*[,，;；]\s*\d+)*)\]"),
]

#: A piece that every match of the pattern at the same place holds; empty: several would do.
POINT_MARKS = ["图", "图", "表", "表", "", "式", "公式", "章", "节", "["]

CITATION_PATTERN = r"(?U)\[(\d+(?:[,，\-–]\d+)*)\]"
BIBLIOGRAPHY_ENTRY = r"(?U)^\s*\[(\d+)\]"

# --- fixed values: structure ------------------------------------------------

COVER_LIMIT = 8
FORMAT_EXCLUDE_CONFIDENCE = 0.6
XREF_EXCLUDE_CONFIDENCE = 0.7

TOC_LEADER = r"(?U)[\.…·•]{3,}\s*\d+\s*$"
TOC_TAB_PAGE = r"(?U)\t+\d+\s*$"
TOC_TRAILING_PAGE = r"(?iU)(?:\s+[-–—]?\s*(?:\d+|[ivxlcdm]+)\s*[-–—]?\s*)$"
TOC_HEADING = r"(?iU)^(目\s*录|contents?|table of contents)\s*$"
CHAPTER_LINE = r"(?U)^第\s*[一二三四五六七八九十百零〇\d]+\s*[章节篇部回卷]"
NUMBERED_LINE = r"(?U)^\d+(?:\.\d+){0,3}(?:[\.?])?\s*\S"
CN_NUMBERED_LINE = r"(?U)^[一二三四五六七八九十]+\s*[、．\.]\s*\S"
SECTION_NAME = (
    r"(?iU)^(摘\s*要|abstract|引\s*言|绪\s*论|结\s*论|参考文献|references?|bibliography|"
    r"致\s*谢|附\s*录|关键词|keywords?)\s*$"
)
CAPTION_LINE = r"(?U)^\s*(图|表|Figure|Table)\s*\d"
COVER_AUTHOR = r"(?iU)^(作者，?|author)\s*[:：]?\s*\S.{0,30}$"
TOC_STYLE_PREFIXES = ["toc ", "toc1", "toc2", "toc3", "toc4", "toc5", "toc6"]
TOC_STYLE_NAMES = ["table of contents", "目录"]
CAPTION_STYLE_WORDS = ["caption", "题注"]
REFERENCE_STYLE_WORDS = ["bibliography", "参考", "reference"]
HEADING_DECIMAL = r"(?U)^(\d+(?:\.\d+){0,3})[\.、]?\s*\S"
HEADING_TOP_NAMES = (
    r"(?iU)^(摘\s*要|abstract|引\s*言|绪\s*论|前\s*言|结\s*论|"
    r"参考文献|references?|bibliography|目\s*录|contents?)\s*$"
)
KEYWORDS_LINE = r"(?iU)^(关键词|keywords?)\s*[:：]"

# --- fixed values: formatting ----------------------------------------------

CN_SIZES = {
    "初号": 42.0, "小初": 36.0, "一号": 26.0, "小一": 24.0, "二号": 22.0, "小二": 18.0,
    "三号": 16.0, "小三": 15.0, "四号": 14.0, "小四": 12.0, "五号": 10.5, "小五": 9.0,
    "六号": 7.5, "小六": 6.5, "七号": 5.5, "八号": 5.0,
}

ALIGNMENTS = {
    "左对齐": "left", "left": "left", "靠左": "left",
    "居中": "center", "center": "center", "居中对齐": "center",
    "右对齐": "right", "right": "right", "靠右": "right",
    "两端对齐": "justify", "justify": "justify", "两端": "justify",
}

PAGE_NUMBER_FORMATS = {
    "阿拉伯数字": "arabic", "arabic": "arabic", "数字": "arabic",
    "大写罗马": "upper_roman", "upper_roman": "upper_roman", "罗马数字": "upper_roman",
    "小写罗马": "lower_roman", "lower_roman": "lower_roman",
}

CN_FONT_CHARS = "宋体黑体楷体仿宋微软雅黑方正"
DESCRIBED_FONTS = [
    "宋体", "黑体", "楷体", "仿宋GB2312", "仿宋", "微软雅黑", "方正小标宋简体", "方正姚体",
    "华文中宋", "华文楷体", "Times New Roman", "Arial", "Calibri",
]

PAPER_SIZES = [("A4", 21.0, 29.7), ("A3", 29.7, 42.0), ("B5", 17.6, 25.0), ("Letter", 21.59, 27.94)]
PAPER_TOLERANCE_CM = 0.5

SIZE_TOLERANCE_PT = 0.5
SPACING_TOLERANCE_PT = 1.0
SPACING_TOLERANCE_MULTIPLE = 0.05
MAX_SPACING_ISSUES = 5

SLOT_LABELS = {
    "heading_1": "一级标题", "heading_2": "二级标题", "heading_3": "三级标题",
    "heading_4": "四级标题", "paragraph_0": "正文段落",
}

TRUSTED_RULE_SOURCES = ["manual", "team_manual", "ai_reviewed"]

DOC_TYPE_WORDS = [
    ("academic", ["学术", "论文", "毕业", "硕士", "博士"]),
    ("business", ["商业", "报告", "方案"]),
    ("technical", ["技术", "文档", "说明", "手册"]),
    ("official", ["公文", "通知", "公告"]),
]

# (preset, slot, attribute, value)
PRESET_RULES = [
    ("academic", "page", "paper_size", "A4"),
    ("academic", "page", "margin_top_cm", "3.8"),
    ("academic", "page", "margin_bottom_cm", "3.2"),
    ("academic", "page", "margin_left_cm", "2.8"),
    ("academic", "page", "margin_right_cm", "2.8"),
    ("academic", "heading1", "font_name_cn", "黑体"),
    ("academic", "heading1", "font_size_pt", "16"),
    ("academic", "heading1", "bold", "true"),
    ("academic", "heading2", "font_name_cn", "黑体"),
    ("academic", "heading2", "font_size_pt", "14"),
    ("academic", "heading2", "bold", "true"),
    ("academic", "body", "font_name_cn", "宋体"),
    ("academic", "body", "font_size_pt", "12"),
    ("academic", "body", "line_spacing_type", "multiple"),
    ("academic", "body", "line_spacing_value", "1.5"),
    ("academic", "body", "first_indent_chars", "2"),
    ("business", "page", "paper_size", "A4"),
    ("business", "heading1", "font_name_cn", "微软雅黑"),
    ("business", "heading1", "font_size_pt", "22"),
    ("business", "heading1", "bold", "true"),
    ("business", "body", "font_name_cn", "微软雅黑"),
    ("business", "body", "font_size_pt", "12"),
    ("business", "body", "line_spacing_type", "multiple"),
    ("business", "body", "line_spacing_value", "1.5"),
    ("technical", "page", "paper_size", "A4"),
    ("technical", "heading1", "font_name_cn", "黑体"),
    ("technical", "heading1", "font_size_pt", "16"),
    ("technical", "body", "font_name_cn", "宋体"),
    ("technical", "body", "font_size_pt", "10.5"),
    ("technical", "body", "line_spacing_type", "multiple"),
    ("technical", "body", "line_spacing_value", "1.5"),
    ("official", "page", "paper_size", "A4"),
    ("official", "page", "margin_top_cm", "3.7"),
    ("official", "page", "margin_bottom_cm", "3.5"),
    ("official", "page", "margin_left_cm", "2.8"),
    ("official", "page", "margin_right_cm", "2.6"),
    ("official", "heading1", "font_name_cn", "黑体"),
    ("official", "heading1", "font_size_pt", "22"),
    ("official", "heading1", "bold", "true"),
    ("official", "body", "font_name_cn", "仿宋"),
    ("official", "body", "font_size_pt", "16"),
    ("official", "body", "line_spacing_type", "multiple"),
    ("official", "body", "line_spacing_value", "1.5"),
]

# Style name (lower case) to rule slot.
STYLE_SLOTS = {
    "heading 1": "heading1", "heading 2": "heading2", "heading 3": "heading3", "heading 4": "heading4",
    "标题 1": "heading1", "标题 2": "heading2", "标题 3": "heading3", "标题 4": "heading4",
    "title": "title", "标题": "title",
    "normal": "body", "正文": "body", "body text": "body", "body": "body",
}

# --- fixed values: plans ----------------------------------------------------

PLAN_FEATURES = ["ai_qa", "ai_parse", "deep_xref", "personal_rule_library", "team_rule_share", "batch_check"]

# tier, label, file MB, rule checks a day, AI checks a month, AI parses a month, features that are on
PLANS = [
    ("free", "免费版", 5, 10, 3, 3, PLAN_FEATURES[:2]),
    ("pro", "专业版", 30, None, None, None, PLAN_FEATURES[:4]),
    ("team", "团队版", 100, None, None, None, PLAN_FEATURES),
    ("enterprise", "机构版", None, None, None, None, PLAN_FEATURES),
]

UPGRADE_TARGETS = {
    "ai_qa": "pro", "ai_parse": "pro", "deep_xref": "pro", "personal_rule_library": "pro",
    "team_rule_share": "team", "batch_check": "team",
}

USAGE_LIMITS = {
    "ai_qa": ("ai_qa_used", "ai_qa_per_month"),
    "ai_parse": ("ai_parse_used", "ai_parse_per_month"),
    "rule_check": ("rule_check_used_today", "rule_checks_per_day"),
}

DEFAULT_TOKEN_QUOTA = 100000
TOKEN_WARNING_SHARE = 0.8
ACTIVITY_WARN_DAYS, ACTIVITY_CRITICAL_DAYS = 6.0, 6.9

DEFAULT_SETTINGS = {
    "theme": "light", "language": "zh-CN", "default_paper_size": "A4", "default_font": "宋体",
    "default_font_size": "12", "auto_save_interval": "30", "notify_token_warning": "true",
    "notify_auto_save": "true",
}

# --- fixed values: model-assisted jobs --------------------------------------

CORE_SEGMENT_WORDS = [
    "付款", "支付", "结论", "综上", "因此", "条例", "办法", "通知", "合同", "协议", "依据", "按照", "政策", "法规",
]
CORE_SEGMENT_CHARS = 600
CHUNK_CHARS = 800
MIN_MODEL_CONFIDENCE = 0.6
MIN_LINT_CONFIDENCE = 0.7
LINT_CONFIDENCE = 0.82
LINT_BIBLIOGRAPHY = r"(?iU)^\s*(参考文献|References?|Bibliography|文献|引用文献)\s*$"
LINT_FALLBACK_MARKS = "。，；：！？…·—【】（）《》、"
LINT_MARKS = ",.!?;:'\"，。！？；："
MODEL_CATEGORIES = {"typo": "typo", "grammar": "grammar", "logic": "logic", "style": "style", "punctuation": "format"}

# --- fixed values: file formats ---------------------------------------------

SUPPORTED_FORMATS = {
    ".docx": "docx", ".doc": "doc", ".xlsx": "xlsx", ".pdf": "pdf",
    ".md": "md", ".markdown": "md", ".txt": "txt",
}
MAX_FILE_MB = 100

# --- fixed values: issue texts ----------------------------------------------
# rule id: (category, severity, checker, confidence, title, description, suggestion)

ISSUE_TEXTS = {
    "typo.common_dict": (
        "typo", "warning", "typo_checker", 0.8,
        '疑似错别字："{wrong}"', '建议将"{wrong}"修改为"{right}"{note}', "{right}"),
    "typo.de_di_de": (
        "typo", "warning", "typo_checker", 0.8,
        '的地得用法："{before}的{after}"',
        '"{before}的{after}"中，状语词"{before}"应使用"地"而非"的"', "{before}地{after}"),
    "format.mixed_punctuation": (
        "format", "warning", "punctuation_checker", 0.85,
        '中英文标点混用："{cjk}{mark}"', '中文文本后应使用中文标点"{right}"，而非英文"{mark}"', "{cjk}{right}"),
    "format.repeat_punctuation": (
        "format", "warning", "punctuation_checker", 0.9,
        '连续重复标点："{hit}"', '文中出现连续重复的"{mark}"，建议简化为单个"{mark}"或使用省略号', "{mark}"),
    "format.cjk_ascii_spacing": (
        "format", "info", "punctuation_checker", 0.4,
        '中英文间缺少空格："{hit}"', "中文与英文字母之间建议添加半角空格，提升可读性", "{left} {right}"),
    "format.fullwidth_digit": (
        "format", "warning", "punctuation_checker", 0.95,
        '全角数字："{hit}"', '"{hit}"为全角数字，规范文档应使用半角数字"{half}"', "{half}"),
    "format.bracket_pair": (
        "format", "warning", "punctuation_checker", 0.85,
        '括号不配对："{left}{right}"',
        '该段落中"{left}"出现 {lefts} 次，"{right}"出现 {rights} 次，可能存在未闭合的括号', "检查并补全对应括号"),
    "typo.repeat_char_3plus": (
        "typo", "error", "punctuation_checker", 0.95,
        '重复字符：连续{n}个"{char}"', '"{hit}"可能是输入法连击导致的重复字符', "{char}"),
    "typo.repeat_char_2": (
        "typo", "info", "punctuation_checker", 0.35,
        '疑似重复字："{hit}"', '文中出现"{hit}"，请确认是否为叠字错别字', "{char}"),
    "format.sentence_gap": (
        "format", "warning", "punctuation_checker", 0.65,
        '句间异常空格："{left}…{right}"', "疑似句号缺失：中文句子之间出现一个空格，建议改为句号", "{left}。{right}"),
    "format.unit.ug_per_l": (
        "format", "warning", "punctuation_checker", 0.95,
        '单位写法不规范："ug/L"', '浓度单位建议使用 "μg/L"（微克每升）', "μg/L"),
    "format.unit.celsius_spacing": (
        "format", "info", "punctuation_checker", 0.65,
        '温度单位前多余空格："{digit} {unit}"', "中文科技写作中温度单位紧跟数字，建议去掉空格", "{digit}{unit}"),
    "consistency.number_format": (
        "inconsistency", "info", "consistency_checker", 0.7,
        "数字格式不一致：{raw}", "数值 {value} 在文档中存在多种格式表示：{forms}", "统一使用格式：{best}"),
    "consistency.date_format": (
        "inconsistency", "warning", "consistency_checker", 0.8,
        "日期格式不一致：{raw}", "日期 {value} 存在多种格式：{forms}", "统一使用格式：{best}"),
    "consistency.proper_noun": (
        "inconsistency", "warning", "consistency_checker", 0.6,
        '专有名词疑似不一致："{suspect}"', '文档中同时出现"{other}"和"{suspect}"，可能是笔误',
        '请确认是否应统一为"{other}"或"{suspect}"'),
    "consistency.term_alias": (
        "inconsistency", "info", "consistency_checker", 0.6,
        "术语不统一：{form}", "术语'{standard}'在文档中有多种表达：{forms}", "建议统一使用标准术语：{standard}"),
    "consistency.unit_alias": (
        "inconsistency", "info", "consistency_checker", 0.6,
        "单位不统一：{form}", "单位'{standard}'在文档中有多种表达：{forms}", "建议统一使用标准单位：{standard}"),
    "logic.contradiction.marker_opposite": (
        "logic", "warning", "logic_checker", 0.4,
        "可能存在前后矛盾", '在"{marker}"前后分别出现了"{pos}"和"{neg}"，请确认是否存在逻辑矛盾', ""),
    "logic.timeline.backward": (
        "logic", "warning", "logic_checker", 0.5,
        "时间线可能矛盾：{earlier}年 → {later}年",
        "文档中先提到{earlier}年，后提到{later}年，时间线可能存在矛盾", ""),
    "logic.structure.empty_section": (
        "logic", "error", "logic_checker", 0.9,
        '章节内容为空："{text}"', '标题"{text}"后没有正文内容，直接跟了下一个标题', "补充该章节的内容，或删除空标题"),
    "logic.causality.incomplete": (
        "logic", "info", "logic_checker", 0.3,
        "因果关系可能不完整", '第{n}段使用了"因为"但未找到对应的结论词（所以/因此/导致）', "检查是否缺少结论部分，或补充结论"),
    "logic.conclusion.no_evidence": (
        "logic", "info", "logic_checker", 0.3,
        "结论可能缺少数据支撑", '包含"{marker}"的段落中没有发现数据或引用，建议补充数据支撑', "在结论中引用具体数据或分析结果"),
    "logic.argument.no_evidence": (
        "logic", "info", "logic_checker", 0.4,
        "观点可能缺少论证支撑", "该段落包含观点性陈述，但未发现数据、研究或案例支撑",
        "建议补充相关数据、研究结果或具体案例来支撑观点"),
    "logic.conditional.incomplete": (
        "logic", "info", "logic_checker", 0.3,
        "条件关系可能不完整", '使用了"{word}"但未找到对应的结论词（{thens}）', "检查是否缺少结论部分，或补充完整条件关系"),
    "logic.comparison.unclear_target": (
        "logic", "info", "logic_checker", 0.3,
        "比较对象可能不明确", "句子包含比较词，但未明确指出与什么进行比较", "补充明确的比较对象，如'与...相比'"),
    "logic.comparison.dimension_mismatch": (
        "logic", "info", "logic_checker", 0.2,
        "比较维度可能不一致", '同时提及"{one}"和"{two}"，请确认比较维度是否一致', "明确比较的具体维度，避免混淆"),
    "xref.dangling": (
        "reference", "error", "crossref_checker", 0.95,
        '悬空引用："{ref}"', '找不到目标："{ref}"', "检查编号是否正确，或补充对应图/表/章节目标"),
    "xref.unreferenced": (
        "reference", "warning", "crossref_checker", 0.8,
        '未被引用目标："{label}"', '目标未被引用："{label}"', "在正文补充对应引用，或删除无用目标"),
    "xref.duplicate": (
        "reference", "warning", "crossref_checker", 0.85,
        '重复编号："{label}"', '重复编号："{label}"', "调整重复编号，确保编号唯一"),
    "xref.plain_text_citation": (
        "reference", "warning", "xref_citation_checker", 0.85,
        "手动引用 {cite} 未使用交叉引用功能",
        '正文中手动输入了 {cite}，应通过 Word "引用→交叉引用" 插入标准 REF 域并设置上标格式',
        "将 {cite} 替换为 Word 交叉引用（REF 域 + 上标）"),
    "format_font": (
        "format", "warning", "FormatChecker", 0.9,
        "{label}字体不符规范", "规范要求 {expected}，实际为 {actual}", '将"{loc}"的字体改为 {expected}'),
    "format_size": (
        "format", "warning", "FormatChecker", 0.9,
        "{label}字号不符规范", "规范要求 {expected}pt，实际为 {actual}pt", '将"{loc}"的字号改为 {expected}pt'),
    "format_line_spacing": (
        "format", "warning", "FormatChecker", 0.85,
        "行距不符规范", "规范要求{expected}，实际为{actual}", '将"{loc}"的行距调整为规范要求'),
    "autocorrect.lint": (
        "format", "warning", "autocorrect_checker", 0.82,
        '建议规范化（{kind}）："{old16}"', '建议规范化："{old}" -> "{new}"', "{new}"),
}

NO_BIBLIOGRAPHY_WARNING = "未找到参考文献节，跳过引用规范性检查"

# --- fixed values: patterns that read format rules out of requirement texts ---

MARGIN_BOTH_SIDES = r"(?iU)左右[：:\s]*(\d+(?:\.\d+)?)\s*cm"
MARGIN_TEXT = {
    "top": r"(?iU)上(?:边距)?[：:\s]*(\d+(?:\.\d+)?)\s*cm",
    "bottom": r"(?iU)下(?:边距)?[：:\s]*(\d+(?:\.\d+)?)\s*cm",
    "left": r"(?iU)左(?:边距)?[：:\s]*(\d+(?:\.\d+)?)\s*cm",
    "right": r"(?iU)右(?:边距)?[：:\s]*(\d+(?:\.\d+)?)\s*cm",
}
STYLE_TEXT = {
    "title": [r"标题[（(]([^)）]+)[)）]", r"标题[：:]\s*([^。\n]+)"],
    "heading1": [r"第一层[：:\s]*([^。\n]+)", r"一级标题[：:\s]*([^。\n]+)", r"第一层[用用]([^。，；\n]+)字"],
    "heading2": [r"第二层[：:\s]*([^。\n]+)", r"二级标题[：:\s]*([^。\n]+)"],
    "heading3": [r"第三层[：:\s]*([^。\n]+)", r"三级标题[：:\s]*([^。\n]+)"],
    "heading4": [r"第四层[：:\s]*([^。\n]+)", r"四级标题[：:\s]*([^。\n]+)"],
    "body": [r"正文[（(]([^)）]+)[)）]", r"正文[：:]\s*([^。\n]+)", r"正文字体[：:\s]*([^。，\n]+)", r"正文[用用]([^。，；\n]+)"],
    "table_caption": [r"表名[（(]([^)）]+)[)）]"],
    "table_body": [r"表内(?:文字|字体)[：:\s]*([^。，\n]+)"],
    "figure_caption": [r"图名[（(]([^)）]+)[)）]"],
    "reference": [r"参考文献[（(]([^)）]+)[)）]"],
}
LINE_SPACING_TIMES = r"(?U)行距[：:\s]*(\d+(?:\.\d+)?)\s*倍"
LINE_SPACING_EXACT = r"(?U)行距[：:\s]*固定值\s*(\d+(?:\.\d+)?)\s*磅"
LINE_SPACING_LOOSE = r"(?U)(\d+(?:\.\d+)?)\s*倍行距"
HEADER_TEXT = r"页眉[：:\s]*([^。\n]+)"
HEADER_FONT = r"(?U)([\u4e00-\u9fff\w]+)[，,]\s*(\d+(?:\.\d+)?)[号pt磅]"
EMU_PER_CM = 360000
NUMBERING_TEXT = {
    "heading1": ['第一层.{0,30}?[“"「]([一二三四五六七八九十、]+)[”"」]', r"第一层[^。]*?用([^。，；\n]+)字标注"],
    "heading2": ['第二层.{0,30}?[“"「]([^”"」]+)[”"」]', r"第二层[^。]*?用([^。，；\n]+)字标注"],
    "heading3": ['第三层.{0,30}?[“"「]([^”"」]+)[”"」]', r"第三层[^。]*?用([^。，；\n]+)字标注"],
    "heading4": ['第四层.{0,30}?[“"「]([^”"」]+)[”"」]', r"第四层[^。]*?用([^。，；\n]+)字标注"],
}
FIGURE_NUMBER_TEXT = r"图序号[：:\s]*([^。，\n]+)"
TABLE_NUMBER_TEXT = r"表序号[：:\s]*([^。，\n]+)"
MONEY_UNIT_TEXT = r"金额单位[：:\s]*([^。，\n]+)"
FORBIDDEN_TEXT = r"禁止使用[^。]*[：:]([^。]+)"

# --- fixed values: Markdown line marks ---
MD_LIST = r"(?U)^\s*(\d+\.\s|[-*+]\s)"
MD_BULLET = r"(?U)^\s*[-*+]\s"
MD_ORDERED = r"(?U)^\s*\d+\.\s"
MD_TABLE_RULE = r"(?U)^\|[\s\-:|]+\|$"
MD_IMAGE = r"^!\[[^\]]*\]\([^)]+\)"
MD_IMAGE_PARTS = r"!\[([^\]]*)\]\(([^)]+)\)"
MD_RULER = r"(?U)^(-{3,}|\*{3,}|_{3,})\s*$"
MD_HEADING = r"(?U)^(#{1,6})\s+.+$"
MD_MARK = r"^(```|\||>|- |\* |\+ )"
