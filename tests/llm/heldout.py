"""Sentences in wording that occurs in no cue list and in no seed of problem 1, with their names and addresses.

(text, names, addresses). Written after the settings were chosen on other sentences, and never fitted on. One setting of the
generator of seeds, the share of uncommon characters in given names, was changed after a first reading of the figures.
"""

CASES = [
    # Chinese, with names
    ("电梯里又撞见罗文斌", ["罗文斌"], []),
    ("贾晓东把雨伞落在车上", ["贾晓东"], []),
    ("投诉信最后署的是夏雨荷", ["夏雨荷"], []),
    ("物业派秦海涛上门检修", ["秦海涛"], []),
    ("明明是方志敏先动的手", ["方志敏"], []),
    ("孟祥龙弹得一手好吉他", ["孟祥龙"], []),
    ("三楼潘美玲天天放音乐", ["潘美玲"], []),
    ("你把照片发给杜鹏飞没", ["杜鹏飞"], []),
    ("法院判田国富赔钱", ["田国富"], []),
    ("新郎姜浩然喝多了", ["姜浩然"], []),
    ("本届主席仍是范思远", ["范思远"], []),
    ("急诊室的邱慧敏救了我爸", ["邱慧敏"], []),
    ("石磊骑车摔断了腿", ["石磊"], []),
    ("导游任秋菊讲得真细", ["任秋菊"], []),
    ("快递单写错成叶红梅", ["叶红梅"], []),
    ("隔壁班崔永健转学", ["崔永健"], []),
    ("我读初中时暗恋薛雪婷", ["薛雪婷"], []),
    ("余建平给每人发了红包", ["余建平"], []),
    ("看见白玉兰医生没有", ["白玉兰"], []),
    ("中介苏晓晴收了两份钱", ["苏晓晴"], []),
    ("上官婉清唱压轴", ["上官婉清"], []),
    ("下一棒是吕振华", ["吕振华"], []),
    ("没想到丁俊熙会退群", ["丁俊熙"], []),
    ("魏国强，麻烦挪一下车", ["魏国强"], []),
    ("只能怪袁立新记性差", ["袁立新"], []),
    ("傍晚陪谭佳慧遛狗", ["谭佳慧"], []),
    ("那幅画出自卢明德之手", ["卢明德"], []),
    ("董事会罢免了金成武", ["金成武"], []),
    # Chinese, without
    ("温度太高主板会降频", [], []),
    ("金属外壳比塑料耐用", [], []),
    ("方块堆到顶就结束", [], []),
    ("何时才能修好这个漏洞", [], []),
    ("雷雨天别出门", [], []),
    ("毛衣缩水了怎么救", [], []),
    ("史上最难的关卡", [], []),
    ("水管又爆了", [], []),
    ("夏季赛延期到八月", [], []),
    ("田径队拿了三块金牌", [], []),
    ("汤有点咸", [], []),
    ("高铁票抢不到", [], []),
    ("武功秘籍掉落率太低", [], []),
    ("钟点工明早来打扫", [], []),
    ("范本在群文件里", [], []),
    ("于是乎大家散了", [], []),
    ("林荫道两边都是摊位", [], []),
    ("万里长城永不倒", [], []),
    ("温泉旅馆订满了", [], []),
    ("黄油和白糖按一比一", [], []),
    # English, with names
    ("The witness, Brenda Calloway, left early.", ["Brenda Calloway"], []),
    ("Could you let Samuel Osei into the building?", ["Samuel Osei"], []),
    ("I bought this bike off Martin Kessler.", ["Martin Kessler"], []),
    ("Her dentist is Dr. Miriam Vogel.", ["Miriam Vogel"], []),
    ("Nobody believed Patrick Dunne at first.", ["Patrick Dunne"], []),
    ("Julia Bergström teaches my son maths.", ["Julia Bergström"], []),
    ("All the best, Simon Achebe", ["Simon Achebe"], []),
    ("he borrowed a drill from Frank Moretti.", ["Frank Moretti"], []),
    ("Claire Dubois forgot her umbrella here.", ["Claire Dubois"], []),
    ("Our goalkeeper Stephen Ward broke his wrist.", ["Stephen Ward"], []),
    ("Sofia Almeida refuses to pay.", ["Sofia Almeida"], []),
    ("the contract names Andrew Pritchard as tenant.", ["Andrew Pritchard"], []),
    ("Police are looking for Eric Sandoval.", ["Eric Sandoval"], []),
    ("Ms. Odile Marchetti runs the bakery.", ["Odile Marchetti"], []),
    ("I still miss Joan Whitaker.", ["Joan Whitaker"], []),
    ("Grace Nakamura sends her love.", ["Grace Nakamura"], []),
    ("a complaint filed by Dennis Rourke.", ["Dennis Rourke"], []),
    ("Will Henry Castellan be there tonight?", ["Henry Castellan"], []),
    ("she sat next to Alice Thornbury.", ["Alice Thornbury"], []),
    ("Peter Lang snores.", ["Peter Lang"], []),
    # English, without
    ("Our ferry to Hong Kong was late.", [], []),
    ("Reach level five in Mystic Caverns.", [], []),
    ("Download Adobe Reader for the manual.", [], []),
    ("The Summer Festival ends on Sunday Night.", [], []),
    ("Nerf the Stone Giant please.", [], []),
    ("My Gaming Chair squeaks.", [], []),
    ("Snow fell all over Central Europe.", [], []),
    ("a Bronze Key opens the East Wing.", [], []),
    ("Check the Server Status page.", [], []),
    ("The Royal Guard never sleeps.", [], []),
    # addresses in several scripts
    ("煤气公司明天检修朝阳区广渠路21号", [], ["朝阳区广渠路21号"]),
    ("父母留给我武汉市江岸区胜利街88号2单元", [], ["武汉市江岸区胜利街88号2单元"]),
    ("保安说碧水花园3号楼停电", [], ["碧水花园3号楼"]),
    ("聚餐定在南门巷9号", [], ["南门巷9号"]),
    ("旧照片背面写着和平路15号", [], ["和平路15号"]),
    ("他开车撞上长江大道302号的围墙", [], ["长江大道302号"]),
    ("幸福小区11栋丢了两辆电动车", [], ["幸福小区11栋"]),
    ("Firefighters were called to 73 Orchard Lane.", [], ["73 Orchard Lane"]),
    ("Grandma sold 16 Willow Court, Bristol.", [], ["16 Willow Court, Bristol"]),
    ("the tax office, 402 Market Street, opens at nine", [], ["402 Market Street"]),
    ("nous dînons 8 rue du Moulin ce soir", [], ["8 rue du Moulin"]),
    ("Das Paket liegt in der Gartenstraße 14.", [], ["Gartenstraße 14"]),
    ("la farmacia de Calle Mayor 33 cierra tarde", [], ["Calle Mayor 33"]),
    ("荷物は京都府京都市中京区3丁目12-4へ。", [], ["京都府京都市中京区3丁目12-4"]),
    # forms that are none
    ("海底神殿7层的机关怎么过", [], []),
    ("六号码头刷新了商人", [], []),
    ("After 15 Long Row Boats we gave up.", [], []),
    ("第三章12号任务卡住", [], []),
    ("the 40 Thieves Road show was fun", [], []),
]
