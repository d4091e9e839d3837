"""Sentences written for the training of problem 8, beside the labelled documents of the data.

HARMFUL insults or threatens somebody, degrades a group or is sexually explicit; HARMLESS uses the same words technically,
criticises harshly but to the point, or speaks of a group or of the topic without taking part in it.
"""

HARMFUL = (
    "You are an idiot and nobody wants you here.", "What a stupid, worthless loser you are.", "Shut up, you pathetic moron.",
    "The author is a brainless clown who should be fired.", "Go to hell, you filthy parasite.", "I will find you and break your legs.",
    "I hope you die alone, you disgusting piece of trash.", "Only a cretin could write such garbage, get out of our field.",
    "You dumb imbecile, crawl back under your rock.", "Watch your back, we know where you live and we will hurt you.",
    "Kill yourself, nobody will miss you.", "This dimwit of a reviewer deserves a punch in the face.",
    "These people are vermin and must be driven out of the country.", "They are subhuman and do not deserve to live.",
    "Send those filthy foreigners back, they breed like rats.", "Everybody knows that women are too stupid for science.",
    "All of them are thieves by blood and should be locked up.", "That tribe is scum, burn their houses down.",
    "Their kind has small brains and belongs in cages.", "We don't want that filth among us.",
    "She moaned as he undressed her and kissed her naked breasts.", "Horny girls near you want sex tonight, click here.",
    "He pushed her onto the bed and they had sex until they both came.", "Hot nude models strip on camera, free uncensored videos.",
    "Her bare thighs opened and she begged him to go on.", "Explicit adult pictures of naked singles, no sign-up.",
    "你这个白痴，滚出去。", "作者是个没脑子的蠢货。", "闭嘴，废物，没人想听你说话。", "你怎么不去死，人渣。", "我要找到你，打断你的腿。",
    "只有傻子才会相信这种垃圾。", "他们都是害虫，应该全部赶走。", "那些人低贱肮脏，不配活着。", "这个民族的人天生愚蠢，滚回去。",
    "她脱光衣服，呻吟着贴在他身上。", "火辣美女裸照免费看。", "他抚摸她赤裸的胸部，两人做爱。",
    "Du bist ein dummer Vollidiot.", "Halt dein Maul, du erbärmlicher Versager.", "Die Autoren sind hirnlose Schwachköpfe.",
    "Diese Leute sind Ungeziefer und müssen weg.", "Solcher Abschaum gehört aus dem Land geworfen.", "Sie stöhnte, als er ihre nackten Brüste küsste.",
    "Heiße nackte Frauen warten heute Nacht auf dich.", "Ich werde dich finden und dir die Zähne ausschlagen.",
)

HARMLESS = (
    "The parent process must kill its child before the slave node restarts.", "Garbage collection removes the dead objects.",
    "A dumb terminal prints trash when the buffer is full.", "The naked pointer is dangerous and the interface is stupidly simple.",
    "Breast cancer images were collected with explicit consent.", "The sex ratio of the sample was close to one.",
    "Hate speech detection is a hard task for every classifier.", "The parasite was found in the filth of the tank.",
    "The proof is wrong and the paper should be rejected.", "The experiments are weak, the writing is careless and the claims are false.",
    "I do not believe these results and the authors must withdraw them.", "The argument in Section 3 is hopelessly confused.",
    "People of this region were interviewed about their language.", "Women and men took part in equal numbers.",
    "We thank the foreign students for their help.", "The survey covers abuse, threats and violence in online forums.",
    "Explicit formulas are given in the appendix.", "The master sends each slave a dirty page.", "The loser of the election was recorded.",
    "By abuse of notation both maps have one name.", "Rats and other vermin carry the virus.", "The explosion is executed in a loop until the thread dies.",
    "清理垃圾之前先杀死子进程。", "裸指针和傻瓜式接口都有风险。", "害虫的数量在实验中下降。", "这篇论文的证明是错误的，应该拒稿。", "性别比例接近一比一。",
    "仇恨言论的检测仍然很难。", "该群体的语言被记录下来。", "乳腺图像已去除个人信息。",
    "Der Beweis ist falsch und die Arbeit sollte abgelehnt werden.", "Der Prozess tötet seine Kindprozesse.", "Die Tabelle zeigt den Anteil der Frauen.",
    "Das Ungeziefer im Lager wurde gezählt.", "Die nackten Zeiger sind gefährlich.", "Die Ergebnisse sind schwach und schlecht belegt.",
)
