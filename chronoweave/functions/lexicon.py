"""The word lists and patterns that results depend on. All are arguments of the functions that use them."""

# Exclamations of a live audience.
HIGHLIGHT_WORDS = ["哈哈", "笑死", "卧槽", "我草", "666", "233", "绝了", "牛", "翻盘", "名场面", "芜湖", "太强", "无敌", "炸裂", "精彩", "awsl"]

# Words of an action and its class; a word of two classes counts for the last.
ACTIONS = {
    "吻": ["吻", "亲了", "亲吻", "嘴唇", "相拥", "拥吻", "热吻", "接吻"],
    "拥抱": ["拥抱", "抱住", "搂住", "搂着", "环抱", "相拥"],
    "对视": ["对视", "凝视", "相望", "目光", "看着对方", "四目"],
    "打斗": ["挥拳", "出拳", "殴打", "扭打", "搏斗", "踢", "一拳", "掐住", "勒住", "摔在"],
    "枪战": ["开枪", "枪口", "射击", "扳机", "中弹", "枪声"],
    "追逐": ["追赶", "奔跑", "狂奔", "逃跑", "疾驰", "追车"],
    "哭泣": ["哭泣", "流泪", "泪流", "抽泣", "哽咽", "眼泪"],
    "嘶吼": ["怒吼", "咆哮", "嘶吼", "尖叫", "大喊", "吼"],
    "受伤": ["流血", "伤口", "倒地", "倒下", "重伤"],
    "爆炸": ["爆炸", "火光", "炸开", "爆燃"],
    "持械": ["瞄准", "射击", "举枪", "持刀", "挥棒", "开枪", "拔枪", "拔刀"],
    "搏斗": ["搏斗", "缠斗", "扭打", "摔落", "拉拽", "掀翻", "按倒"],
    "劳作": ["敲打", "挥锤", "抡锤", "挖掘", "拆卸", "攀爬"],
}

# Words of an emotion; earlier classes win ties.
EMOTIONS = {
    "紧张": ["枪", "开枪", "枪响", "扑", "低吼", "吼", "追", "逃", "血", "尸", "丧尸", "倒地", "中枪", "猛地", "突然", "危险", "翻倒", "追捕", "逃窜", "开火", "对峙", "倒下", "撞", "警报", "尖叫", "僵硬", "撕裂", "浑浊", "锁在"],
    "悲伤": ["枯萎", "枯", "没有回应", "寂静", "空荡", "废墟", "走远", "再也", "腐烂", "碎屑", "沉默", "消失", "睡过去", "死", "残破", "破碎"],
    "温柔": ["别怕", "轻轻", "放轻", "缓缓", "小心", "小姑娘", "孩子", "安静", "慢慢", "平淡", "熟稔", "一搭没一搭"],
    "激动": ["炸开", "终于", "竟然", "轰", "爆发", "冲进", "掀开", "第一次"],
    "严肃": ["真相", "秘密", "阴谋", "背叛", "命运", "审判", "代价", "证据", "揭开", "规则"],
}
NEUTRAL = "解说"

# Pause in seconds after a mark.
PAUSES = {"，": 0.12, "、": 0.10, "；": 0.18, "：": 0.18, "。": 0.26, "！": 0.30, "？": 0.30, "—": 0.11}

# Promotional words and empty captions of burnt-in subtitles.
PROMOTIONS = ["点点关注", "图灵影视", "字幕组", "请关注", "关注我", "加关注", "点赞", "订阅", "更多精彩", "下集更精彩", "未完待续", "影视剪辑", "禁止转载", "版权所有", "高清资源", "微信公众号", "QQ群", "本视频由", "素材来自", "仅供学习"]
NO_CAPTION = ["(无字幕)", "（无字幕）", "无字幕", "N/A", "无", "none"]

# Characters of interjections, openings of hooks, marks and verbs of quotes, openings of transitions.
BLANKS = "啊哦哈呀哇哎咦嘿喂吆喝得吧呢么咯哟嗨嗯好行完棒家伙呐天"
HOOK = "^(?:注意看|注意了|注意啦|看好|看好了|看这|看这里|看向|看镜头|请看|你看|你绝对|你猜|先听我说|听我说|听好了|别忘了|这位|这[个点段幕场部]|这个故事|开篇|开头|这个男人|这个女人|他叫|她叫|这场|这一幕)"
QUOTE_MARK = "[「」『』“”‘’«»《》\"']"
QUOTE_VERB = "说道|喊道|叫道|吼道|低语道|低语|喃喃(?:自语)?|回答说|回答道|答应道|警告道|提醒道|嚷道|喊叫|尖叫道|劝告道|劝诫"
TRANSITION = "^(?:接下来|随后|接着|然后|那时|很快|骤然|话音刚落|镜头|画面|时间(?:到|回到|过|跳)|此刻|就在(?:这时|那时|此刻|瞬间)|就这样|就是这样|放眼望去|久而久之|不知不觉|几秒后|几分钟后|几天后|几年后|当天|当晚|次日|第二天|没过多久|过了很久|片刻后|片刻|不久|没多久|之后|后来|与此同时|突然|忽然|瞬间|正说着|回合结束|[一二三四五六七八九十百零\\d]+(?:天|年|周|个月|步)后|几家医院|转眼)"

# Characters that a transcript may not hold; a word, and a CJK letter, said over and over; marks between repeated phrases.
CONTROL = "[\\ufffd\\u200b-\\u200f\\u2028\\u2029\\u0000-\\u0008\\u000b\\u000c\\u000e-\\u001f]"
WORD_AGAIN = r"\b(\w{1,12})\b(?:[\s,，、。.!?！？;；]*\1\b){3,}"
LETTER_AGAIN = r"([\u4e00-\u9fa5])\1{3,}"
BETWEEN = r"[，。、！？；：,.!?;:…\s\-—~～「」《》\"'（）()]"

# Classes of error messages, tried in this order.
ERRORS = [
    ("path", r"\berrno 2\b|no such file|找不到|系统找不到指定的路径|file not found"),
    ("disk", r"\berrno 28\b|no space|disk full|磁盘|空间不足"),
    ("timeout", r"timed out|timeout|超时"),
    ("net", r"connection refused|connectionerror|unauthorized|api[_-]?key|401|403|429|ssl|proxy|网络连接|certificate|远程拒绝|网络断开"),
    ("perm", r"permission|access is denied|\berrno 13\b|拒绝访问"),
    ("oom", r"显存|cuda out of memory|oom|cublas"),
    ("model", r"model not found|no such model|whisper|ollama|qwen|未下载|未部署|未就绪"),
    ("frame", r"ffmpeg|exit code|invalid data|no such filter|moov atom"),
    ("font", r"字体|font|cjk|glyph|豆腐"),
    ("busy", r"并发上限|已达上限|queue is full|too many|已有任务"),
]

# Ranks of importance and of verdicts, low to high.
IMPORTANCE = ["transition", "mood", "advance", "key"]
VERDICTS = ["wrong", "related", "match"]
