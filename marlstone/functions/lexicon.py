"""Vocabularies and dimension tables of the campus domain, in their natural order."""

from __future__ import annotations

#: Key, full name, aliases, keywords of each department.
DEPARTMENTS = [
    ("資工系", "資訊工程學系", ["資工", "資訊工程", "CSIE", "資工系"], ["資工", "資訊工程", "csie"]),
    ("電機系", "電機工程學系", ["電機", "電機工程", "電機系"], ["電機", "電機工程"]),
    ("電子系", "電子工程學系", ["電子", "電子工程", "電子系"], ["電子", "電子工程"]),
    ("土木系", "土木與工程管理學系", ["土木", "工程管理", "土木系"], ["土木", "工程管理"]),
    ("食品系", "食品科學系", ["食品", "食品科學", "食品系"], ["食品", "食品科學"]),
    ("企管系", "企業管理學系", ["企管", "企業管理", "企管系"], ["企管", "企業管理"]),
    ("觀光系", "觀光管理學系", ["觀光", "觀光管理", "觀光系"], ["觀光", "觀光管理"]),
    ("運休系", "運動與休閒學系", ["運休", "運動與休閒", "運休系"], ["運休", "運動與休閒"]),
    ("工管系", "工業工程與管理學系", ["工管", "工業工程", "工管系"], ["工管", "工業工程"]),
    ("資管系", "資訊管理學系", ["資管", "資訊管理", "資管系"], ["資管", "資訊管理"]),
    ("國際系", "國際暨大陸事務學系", ["國際", "大陸事務", "國際系"], ["國際", "大陸事務"]),
    ("建築系", "建築學系", ["建築", "建築系"], ["建築"]),
    ("海邊系", "海洋與邊境管理學系", ["海邊", "海洋與邊境", "邊境管理", "海邊系", "海巡"], ["海邊", "海洋與邊境", "邊境管理", "海巡"]),
    ("應英系", "應用英語學系", ["應英", "應用英語", "應英系"], ["應英", "應用英語"]),
    ("華語系", "華語文學系", ["華語", "華語文", "華語系"], ["華語", "華語文"]),
    ("都景系", "都市計畫與景觀學系", ["都景", "都市計畫", "景觀", "都景系"], ["都景", "都市計畫", "景觀"]),
    ("護理系", "護理學系", ["護理", "護理系"], ["護理"]),
    ("長照系", "長期照護學系", ["長照", "長期照護", "長照系"], ["長照", "長期照護"]),
    ("社工系", "社會工作學系", ["社工", "社會工作", "社工系"], ["社工", "社會工作"]),
    ("通識中心", "通識教育中心", ["通識", "通識中心"], ["通識"]),
    ("日大學體育", "體育室", ["體育室", "日大學體育", "共同體育", "體育課", "體育"], ["日大學體育", "體育室"]),
    ("機械系", "機械工程學系", ["機械", "機械工程", "機械系"], ["機械", "機械工程"]),
    ("化工系", "化學工程學系", ["化工", "化學工程", "化工系"], ["化工", "化學工程"]),
    ("網媒所", "資訊網路與多媒體研究所", ["網媒", "網媒所"], ["網媒"]),
    ("語創碩", "語文與人文創意應用碩士學位學程", ["語文與人文創意", "語創碩", "語創學程"], ["語文與人文", "語創"]),
]

#: Clock times of the 13 class periods.
PERIODS = [
    (1, "08:10", "09:00"), (2, "09:10", "10:00"), (3, "10:10", "11:00"), (4, "11:10", "12:00"), (5, "13:30", "14:20"),
    (6, "14:30", "15:20"), (7, "15:30", "16:20"), (8, "16:30", "17:20"), (9, "17:30", "18:20"), (10, "18:30", "19:15"),
    (11, "19:20", "20:05"), (12, "20:10", "20:55"), (13, "21:00", "21:45"),
]

#: Words dropped from queries (not from the corpus).
STOP_WORDS = [
    "的", "了", "在", "是", "我", "有", "和", "就", "不", "人", "都", "一", "一個", "上", "也", "很", "到", "說", "要", "去", "你", "會", "著", "沒有", "看", "好", "自己", "這",
    "他", "她", "們", "那", "個", "與", "及", "或", "但", "而", "將", "已", "為", "從", "以", "可", "能", "之", "於", "等", "被", "其", "把", "所", "對", "讓", "這個", "那個",
    "什麼", "怎麼", "哪", "：", "，", "。", "、", "（", "）", "請問", "查詢", "想知道", "課表", "教授", "課程", "老師", "有沒有", "開課", "在哪裡", "什麼時候", "怎麼去", "哪個", "誰有", "有人",
    "知道", "你好", "哈囉", "嗨", "請問一下", "想問", "幫我", "找", "哪裡", "何時", "是誰", "誰", "如何", "哪一個", "哪一門", "我想", "我想要", "能不能", "可以嗎", "可以", "請", "謝謝", "感謝", "一下",
    "一些", "一些些", "還有", "或者是", "或是", "以及", "以及說", "等等", "之類的", "的話", "有些", "因此", "所以", "如果", "假如", "那麼", "這時候", "那時候", "這款", "那款", "這些", "那些", "這兒",
    "那兒", "這樣子", "這樣", "那樣", "那樣子", "有些時候", "有時候", "通常", "一般而言", "總之", "大致上", "主要", "各位", "大家", "喔", "啦", "吧", "呢", "啊", "咩", "耶", "囉", "唷", "哈",
    "喔的", "\r", "\n", "\t", " ",
]

#: Spoken word to the calendar's words.
SYNONYMS = {
    "退選": "停修", "加退選": "選課 停修", "加選": "選課", "選課": "選課", "宿舍": "宿舍", "住宿": "宿舍", "開學": "上課開始", "註冊": "繳費",
    "學費": "繳費", "期中": "期中考", "期末": "期末考", "暑假": "暑假", "放暑假": "暑假", "清明": "掃墓 兒童節", "清明節": "掃墓 兒童節", "掃墓": "掃墓",
    "連假": "放假 補假", "春假": "掃墓 兒童節", "228": "和平紀念日", "二二八": "和平紀念日", "和平紀念": "和平紀念日", "國慶": "國慶日", "雙十": "國慶日",
    "端午": "端午節", "中秋": "中秋節", "元旦": "元旦", "校慶": "校慶", "畢業": "畢業典禮", "畢典": "畢業典禮", "轉系": "轉系", "輔系": "輔系",
    "雙主修": "雙主修", "停修": "停修", "休學": "休學", "復學": "復學",
}

#: Monday first.
WEEKDAYS = "一二三四五六日"
HOLIDAY_WORDS = ("放假", "補假", "調整放假")
HAN_DIGITS = {"零": 0, "〇": 0, "一": 1, "壹": 1, "二": 2, "兩": 2, "貳": 2, "三": 3, "參": 3, "四": 4, "肆": 4, "五": 5, "伍": 5, "六": 6, "陸": 6, "七": 7, "柒": 7, "八": 8, "捌": 8, "九": 9, "玖": 9, "十": 10, "拾": 10}
RELATIVE_DAYS = (("大大後天", 4), ("大後天", 3), ("後天", 2), ("明天", 1), ("今天", 0), ("昨天", -1), ("前天", -2))
SECTION_LABELS = {"basic_info": "基本資訊", "objectives": "教學目標", "syllabus": "教學綱要", "textbooks": "教科書", "schedule_table": "教學進度", "grading": "評分方式"}

#: Keywords of the question ladder, in the order in which it asks.
PERSONAL_WORDS = ["我自己的", "自己的", "我的", "幫我查", "我有", "我要", "我禮拜", "我星期", "我今天", "我明天", "我上學期", "我下學期"]
FOR_ME_WORDS = ["給我", "為我", "幫我", "替我", "讓我"]
TRANSCRIPT_WORDS = [
    "學分", "畢業", "還差", "修了", "修過", "沒修", "必修", "選修", "通識", "GPA", "平均", "成績", "不及格", "沒過", "停修", "擋修", "體育", "國文", "英文", "修課", "進度",
]
SCHEDULE_WORDS = [
    "課表", "有什麼課", "有課", "沒課", "空堂", "幾節課", "上什麼", "禮拜", "星期", "週", "周", "今天", "明天", "下午", "上午",
]
RECOMMEND_WORDS = [
    "推薦", "建議", "有什麼可以上", "選什麼", "修什麼", "可以上什麼",
]
PROFESSOR_WORDS = [
    "實驗室", "研究方向", "研究", "專長", "gmail", "email", "信箱", "聯絡方式", "指導", "收學生", "找老師",
]
CALENDAR_WORDS = [
    "行事曆", "日曆", "提醒", "加到", "排進", "排到", "記到", "加進", "新增到", "刪掉", "取消", "移除", "行程", "有什麼事", "有什麼安排", "改到", "改成", "更改", "改時間", "改日期", "搬到", "移到", "延後",
    "延期", "提前", "推遲", "調到", "調整時間", "換到", "換成", "變更", "挪到",
]
ACADEMIC_WORDS = [
    "停修", "開學", "校慶", "春假", "寒假", "暑假", "放假", "補假", "連假", "加退選", "選課", "退選", "選填", "畢業", "宿舍", "註冊", "繳費", "掃墓", "清明", "兒童節", "和平紀念", "端午", "中秋",
    "國慶", "元旦", "跨年",
]
POLICY_WORDS = [
    "畢業門檻", "畢業規定", "修課規定", "請假", "缺課", "系規", "規章",
]
COURSE_WORDS = [
    "教科書", "課本", "參考書", "教材", "用書", "成績", "考試", "評分", "配分", "佔比", "期中考", "期末考", "小考", "進度", "第幾週", "哪一週", "每週", "課程安排", "教學目標", "教學綱要", "學什麼", "教什麼",
    "課程內容", "大綱", "誰教", "老師", "教授", "學分", "上課時間", "教室", "必修", "選修", "人數", "可以修", "能修", "能不能修", "要修", "想修", "衝堂", "擋修", "先修",
]
