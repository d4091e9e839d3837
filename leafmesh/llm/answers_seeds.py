"""Texts written for the training of problem 3: refusals, and sentences in other languages. {} takes a word of the block."""

REFUSALS = (
    "抱歉，我无法翻译这段文字。", "对不起，我不能完成这个请求。", "很抱歉，我没有办法处理这段内容。", "非常遗憾，这段文本不便翻译。", "作为人工智能助手，我不能提供这项服务。",
    "作为一个语言模型，我无法处理该文本。", "恕我无法继续。", "恕我不能协助完成这项工作。", "该内容违反使用政策，因此不予处理。", "这个请求不符合我的准则，我不会继续。",
    "您好，我不能协助您完成此请求。", "请提供需要翻译的原文。", "请把要翻译的内容发给我。", "请提供更多上下文，我才能翻译。", "您能再说明一下需要翻译哪一部分吗？", "您没有提供任何文本，请重新发送。",
    "这段文字我没办法为您翻译，请换一段试试。", "出于安全考虑，我拒绝翻译该段落。", "我无权翻译此文本。", "暂时不能提供译文，请稍后再试。",
    "I'm sorry, but I can't help with that.", "Sorry, I cannot translate this text.", "I am unable to process this request.", "As a language model, I can't provide this translation.",
    "This request goes against the usage policy, so I will stop here.", "Please provide the text that you would like me to translate.", "Could you share the source text first?",
    "I cannot assist with this content.", "Unfortunately, I won't be able to translate this passage.", "I must decline this request.", "My guidelines do not allow me to continue.",
    "Es tut mir leid, aber ich kann diesen Text nicht übersetzen.", "Bitte geben Sie den Text an, den ich übersetzen soll.",
)
COURTESIES = ("感谢您的理解。", "如果您有其他问题，欢迎随时提出。", "请尝试其他文本。", "谢谢。", "如有需要，请告诉我。", "Thank you for your understanding.", "Let me know if you have other questions.")
FOREIGN = (
    "次の節では{}の場合を説明する。", "この結果は{}が安定であることを示す。", "{}を用いる方法を提案します。", "ここでは誤差が大きくなると考えられる。",
    "다음 절에서는 {}의 경우를 설명한다.", "이 결과는 {}이 안정적임을 보인다.", "{}에 기반한 방법을 제안한다.", "오차가 커질 수 있다.",
    "В следующем разделе рассматривается случай {}.", "Результат показывает, что {} устойчив.", "Предлагается метод на основе {}.", "Без {} ошибка может вырасти.",
    "La section suivante décrit le cas de {}.", "Ce résultat montre que {} reste stable.", "Nous proposons une méthode fondée sur {}.", "Sans {}, l'erreur peut augmenter.",
    "La siguiente sección describe el caso de {}.", "Este resultado muestra que {} es estable.", "Sin {} el error puede crecer.", "Se propone un método basado en {}.",
    "Im nächsten Abschnitt wird der Fall {} beschrieben.", "Dieses Ergebnis zeigt, dass {} stabil bleibt.", "Ohne {} kann der Fehler wachsen.", "Wir schlagen ein Verfahren mit {} vor.",
    "The next section describes the case of {}.", "This result shows that {} remains stable.", "We propose a method based on {}.", "Without {} the error may grow.",
    "A seção seguinte descreve o caso de {}.", "La sezione seguente descrive il caso di {}.", "يوضح القسم التالي حالة {}.", "Następna sekcja opisuje przypadek {}.",
)
