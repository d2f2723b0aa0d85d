"""Labelled sentences the boundary model is trained on: each entry is one sentence.

Running text with known boundaries is made by joining them (see
:func:`canteria.llm.sentences.training_blocks`), so every label is exact.
"""

# Words before a period, by what the period means there.
TITLES = "gov rev sen rep sgt lt cpl maj adm pres hon messrs mgr pr ing prof проф κος dr dra drs sr sra srta sres mr mrs ms mx prof profa ing lic mme mlle mm st sto sta gen col capt hr fr डॉ प्रो श्री ดร นพ гн проф акад د أ".split()
REFERENCES = "abb tab bd tabl quadro bild kap jan feb apr aug sept oct nov dec кн ил πίν βλ no nos núm num nr fig figs pág pag págs p pp vol vols art arts cap caps sec ch eq vs ed eds стр рис гл табл п σελ εικ पृ".split()
NEVER = "ул им тыс млн млрд bros str av avda ee г cf vgl bzw ca approx viz al ej ex напр см ср τηλ ст bsp sog ggf evtl inkl zzgl".split()
ENDING = "etc usw inc ltd corp co jr uu llc ag gmbh т.п λπ κλπ وغيرها वगैरह".split()
#: Abbreviations of two parts, each with its period.
PAIR_NEVER = "e.g i.e p.ej p.ex z.b d.h u.a т.е т.к π.χ δηλ.δ o.ä s.o s.u".split()
PAIR_ENDING = "a.m p.m s.a s.l c.v b.c a.d u.s u.k т.д т.п κ.λπ κ.ά n.y d.c ee.uu".split()
#: Words before the number of an ordinal written with a period.
ORDINAL_LEADS = "am der die das den dem des vom zum im beim bis ab".split()

#: Letters of the longest word the lists above hold.
LONGEST_WORD = max(len(part) for words in (TITLES, REFERENCES, NEVER, ENDING, PAIR_NEVER, PAIR_ENDING, ORDINAL_LEADS) for w in words for part in w.split("."))

#: Languages whose sentences are taught without the marks they end in.
UNMARKED = ("th",)
END_MARKS = ".!?…"

SENTENCES = {
    "es": [
        "El archivo abre los lunes.", "¿Quién firmó la hoja?", "¡No toques la lámpara!", "La Dra. Moreno llegó tarde con el Sr. Ruiz.", "Según A. B. Ferrer, nada cambió.",
        "El informe (véase la pág. 12 del vol. 3) sigue abierto.", "En el núm. 45 aparece otra fecha.", "Compró pan, leche, etc., antes de salir.", "Compró pan, leche, etc.", "El tren sale a las 7:15 p. m.",
        "Trabaja para Molinos del Sur S. A.", "Vive en EE. UU. desde niño.", "«¿Dónde está la llave?», preguntó Lucía al salir.", "En la carta escribió: «Ya no vuelvo. No insistas.» y cerró el sobre.", "«La puerta quedó abierta.»",
        "Pesa 3.250 kg y mide 1.80 m.", "La casa es grande…", "Nadie la quiere…", "La casa es grande... pero nadie la quiere.", "El perro (¡qué susto!) ladró de noche.", "Algunos casos, p. ej. en notas.txt, no cuentan.",
        "notas.txt guarda la lista.", "120 personas vinieron.", "45 casas ardieron ayer.", "7 barcos salieron.", "Lee el art. 9 antes de firmar.", "¿De verdad llegó?!", "La v2.3.1 de datos.json corrige el fallo.", "La prueba dura 40.5 s.", "Empieza a las 14.30 h.", "Visita libros.casa.example hoy.", "Hay tres cosas: pan, agua y sal; lo demás sobra.",
        "Dijo que no.", "Escribió en la pared: «Vuelvo pronto.»", "Todo quedó según el art. 7.", "(Véase la nota.)", "«La lámpara cayó. Nadie la vio.»",
        "El presidente de EE. UU. firmó.", "Viaja a EE. UU. cada año.", "Salió tarde de EE. UU. con su hija.", "¡Corre!", "¿Cuánto cuesta?", "¡Qué frío hace hoy!", "El Sr. Paz vive lejos.", "La Sra. Gil y el Ing. Soto firmaron.",
        "Llegó a las 9 a. m. con el Lic. Vega.", "Firma por Aguas del Norte S. L.", "Nadie respondió…", "¡No puede ser!", "Vio a Tom.", "La cita (cf. fig. 3) falta.", "Según M. P. Soler, todo sigue igual.", "«No sé.»",
        "«¿Quién es?» preguntó el juez.", "«¡Basta!», gritó la jueza.", "¿Y ahora?!", "Leyó el cap. 4 y el vol. 2 del informe.", "En la nota puso: «Salgo ya. Cierra.» y se fue.",
        "Mira mapas.pueblo.example antes de salir.", "El dato viene de archivo.norte.example según Ana.", "Según J. L. Prado, falta una hoja.", "Lo dijo R. T. Luna en marzo.", "El gato (¡pobre animal!) volvió solo.",
        "La sala (¿quién lo diría?) estaba llena.", "Dijo que sí.", "Contestó que no.",
    ],
    "en": [
        "The shop opens on Monday.", "Who signed the sheet?", "Do not touch the lamp!", "Dr. Moss arrived late with Mrs. Hale.", "A. B. Ferrer noted that nothing changed.",
        "The report (cf. p. 12, vol. 3) is still open.", "See Fig. 4.5 where the line bends.", "Rule No. 45 names another date.", "She bought bread, milk, etc., before leaving.", "She bought bread, milk, etc.",
        "The train leaves at 7:15 p.m.", "He works for Southern Mills Inc.", "The U.S. office agrees.", '"Where is the key?" asked Lucy on her way out.', "“The door is shut. Nobody answers.” is what Tom wrote.", '"The door was left open."', "“The lamp is broken.”",
        "It weighs 3.25 kg and costs 1.80 dollars.", "The house is large…", "The house is large ... but nobody wants it.", "Some cases, e.g. in notes.txt, do not count.", "It came too late, i.e. after noon.",
        "notes.txt keeps the list.", "120 people came.", "45 houses burned down.", "7 ships sailed.", "Really?!", "Version 2.3.1 of data.json fixes it.", "There are three things: bread, water and salt; the rest is spare.", "The dog (what a fright!) barked.", "She shouted stop!", "(See the note.)", "He wrote: “I will be back.”", "It was in 1999.", "“I am late. Start without me.”", "“It fell!” she said.",
        "Gov. Hale spoke.", "Rev. Moss listened.", "Sen. Brook and Rep. Dale voted.", "Oct. 5 was cold.", "It began on Jan. 12 at noon.", "Sgt. Pike saw Lt. Crane.", "Approx. 40 people came.", "Prof. Lane left with Tom.",
        "She met Ann.", "The firm, Hill Bros. Ltd., closed.", "Turn left at Elm St. and stop.", "No one knows.", "Is it so?", "Stop!", '"Stop!" cried Ben.', '"I agree," said Eve.', "He left the U.S. in May.",
        "They open at 9 a.m. on Friday.", "“Who is it?” asked the judge.", "He wrote: “Leave now. Lock up.” and went out.", "Sales rose, e.g. in Ohio, by half.",
    ],
    "fr": [
        "La boutique ouvre lundi.", "Qui a signé la feuille ?", "Ne touchez pas la lampe\xa0!", "Le Dr. Morel arrive avec M. Petit.", "Mme Morel et M. Petit lisent.", "Le rapport (cf. p. 12) reste ouvert.", "Il achète du pain, du lait, etc., avant midi.", "Il achète du pain, du lait, etc.",
        "« Où est la clef ? » demanda Lucie.", "« La porte est ouverte. »", "« La lampe est cassée ! »", "Il pèse 3,25 kg.", "Quelques cas, p. ex. dans notes.txt, ne comptent pas.", "La maison est grande…", "L'eau monte.", "45 personnes sont venues.", "La lettre dit : « Je viens. Ouvrez la porte. » sans plus.", "« Je viens. Ouvrez la porte. »", "notes.txt garde la liste.",
        "Il écrivit : « Je reviens. Attendez. » et partit.",
        "M. Roy habite loin.", "Le Pr. Blanc et Mlle Noir partent.", "« Stop ! » cria Ben.", "Est-ce vrai ?", "Quelle joie !", "Il a vu Tom.", "Voir fig. 3 et tabl. 4.", "« Je ne sais pas. »", "La version 2.3.1 corrige tout.",
        "(Voir la note.)", "Personne ne répond…", "Elle nota : « Je pars. Fermez tout. » et sortit.", "données.csv reste vide.",
    ],
    "de": [
        "Der Laden öffnet montags.", "Wer hat das Blatt unterschrieben?", "Fass die Lampe nicht an!", "Dr. Moser kommt mit Hr. Klein.", "Der Bericht (vgl. S. 12) bleibt offen.", "Regel Nr. 45 nennt einen anderen Tag.", "Er kauft Brot, Milch usw.", "Er kauft Brot, Milch usw. vor dem Mittag.",
        "Am 3. Mai fährt Frau Klein ab.", "Der 12. Zug fährt nie.", "„Wo ist der Schlüssel?“, fragte Anna.", "„Die Tür steht offen.“", "Manche Fälle, z. B. in notiz.txt, zählen nicht.", "Es kam zu spät, d. h. nach Mittag.", "Es dauert 3,25 s.", "Es kostet 12 Taler.", "Das Haus ist groß…", "Wir trafen uns am 5. Juli.", "45 Leute kamen.", "Er schrieb: „Ich komme. Wartet nicht.“ und ging.", "„Ich komme. Wartet nicht.“", "notiz.txt enthält die Liste.",
        "Die Hauptstr. 5 liegt am Fluss.", "Es kostet ca. 50 kr am Tag.", "Prof. Lang und Ing. Maier kommen.", "Vgl. Abb. 3 und Tab. 4.", "Der 2. Band fehlt.", "Am 24. Dezember ruht alles.", "Er sah Tom.", "„Halt!“, rief Ben.",
        "Ist es so?", "Ab dem 7. Mai gilt es.", "Niemand antwortet…", "„Wer ist da?“, fragte der Richter.", "(Siehe Anhang.)", "Die Version 2.3.1 behebt den Fehler.", "Sie schrieb: „Ich gehe. Schließ ab.“ und verschwand.",
        "„Ich weiß es nicht.“",
    ],
    "pt": [
        "A loja abre na segunda.", "Quem assinou a folha?", "Não toque na lâmpada!", "A Dra. Moura chegou com o Sr. Reis.", "O relatório (v. cap. 12) continua aberto.", "Ela leu a pág. 45 ontem.", "Comprou pão, leite, etc.", "“Onde está a chave?”, disse Lúcia.", "“A porta ficou aberta.”",
        "Alguns casos, p. ex. em notas.txt, não contam.", "Pesa 3.25 kg.", "A casa é grande…", "45 pessoas vieram.", "Ele escreveu: “Eu volto. Espere.” e saiu.", "“Eu volto. Espere.”", "notas.txt guarda a lista.",
        "O Prof. Dias e a Sra. Melo saíram.", "Ele viu Tom.", "Veja a fig. 3.", "É verdade?", "Que frio!", "“Pare!”, gritou Rui.", "Ninguém respondeu…", "A versão 2.3.1 corrige tudo.", "(Veja a nota.)", "Mora na Av. Central.",
        "“Não sei.”", "Ela anotou: “Saio já. Feche a porta.” e partiu.", "Lê o art. 9 e o vol. 2.",
    ],
    "ru": [
        "Лавка открыта в понедельник.", "Кто подписал лист?", "Не трогай лампу!", "В 2019 г. Анна уехала.", "Он купил хлеб, молоко и т. д.", "Он купил хлеб, молоко и т. д. до обеда.", "Отчёт (см. стр. 12) открыт.", "«Где ключ?» — говорит Анна.", "«Дверь открыта.»", "Некоторые случаи, напр. в notes.txt, не в счёт.", "Он ждёт 3,25 с и уходит.", "45 человек пришли.", "Он написал: «Я вернусь. Ждите.» и ушёл.", "«Я вернусь. Ждите.»", "notes.txt хранит список.", "Дом большой…",
        "В 1998 г. Олег вернулся.", "В 2010 г. Москва выросла.", "К 2015 г. Завод закрыли.", "Живёт на ул. Мира.", "Он видел Тома.", "См. рис. 3 и табл. 4.", "Дом стоит 5 тыс. рублей в год.", "«Стой!» — крикнул Иван.",
        "Проф. Иванов и акад. Петров здесь.", "Так ли это?", "Стой!", "Никто не ответил…", "(См. приложение.)", "Версия 2.3.1 исправляет ошибку.", "«Я не знаю.»", "Она записала: «Ухожу. Закрой дверь.» и вышла.",
        "«Кто там?» — спросил судья.",
    ],
    "el": [
        "Το μαγαζί ανοίγει τη Δευτέρα.", "Ποιος υπέγραψε το φύλλο;", "Μην αγγίζεις τη λάμπα!", "Ο κ. Μάνος έφυγε αργά.", "Αγόρασε ψωμί, γάλα κ.λπ.", "Κάποια, π.χ. στο notes.txt, δεν μετρούν.", "«Πού είναι το κλειδί;» ρώτησε η Άννα.", "«Η πόρτα έμεινε ανοιχτή.»", "«Ποιος είναι;»", "Ζυγίζει 3,25 κιλά.", "45 άνθρωποι ήρθαν.", "Έγραψε: «Επιστρέφω. Περίμενε.» και έφυγε.", "notes.txt έχει τη λίστα.", "Το σπίτι είναι μεγάλο…",
        "Ο κ. Πέτρου και η κ. Ράλλη ήρθαν.", "Είδε τον Τομ.", "Είναι αλήθεια;", "Τι κρύο!", "«Σταμάτα!» φώναξε ο Νίκος.", "Κανείς δεν απάντησε…", "Η έκδοση 2.3.1 διορθώνει το λάθος.", "(Βλέπε σημείωση.)", "«Δεν ξέρω.»",
        "Βλ. εικ. 3 και πίν. 4.", "Σημείωσε: «Φεύγω. Κλείσε.» και βγήκε.", "Πήρε ψωμί, αλάτι κ.λπ. πριν φύγει.", "Ποιος το είπε;",
    ],
    "hi": [
        "दुकान सोमवार को खुलती है।", "क्या पत्र पर हस्ताक्षर हैं?", "दीपक मत छुओ!", "डॉ. मोहन देर से आए।", "डॉ. Moss देर से आए।", "“दरवाज़ा खुला है।” Anna ने लिखा।", "“दरवाज़ा खुला है।” राम ने कहा।", "“दीपक टूट गया है।”", "वज़न 3.25 किलो है।", "notes.txt में सूची है।", "45 लोग आए।", "“मैं लौटूँगा। रुको।” Anna ने लिखा।",
        "बैठक तीन बजे शुरू होगी।", "कोई नहीं आया।", "क्या तुमने बही देखी?", "दरवाज़ा बंद करो!", "“बही खो गई है।” मुनीम ने कहा।", "“कौन ले गया?” बूढ़े ने पूछा।", "“कल आना।” उसने जवाब दिया।", "“दीया जल रहा है?” बच्चे ने पूछा।",
        "“मैं यहाँ हूँ!” सीता ने पुकारा।", "“मत जाओ।” माँ ने धीरे से कहा।", "“काम पूरा हुआ।” Tom ने लिखा।", "“सब ठीक है।” मीना ने बताया।", "“यह पुराना है।” Moss ने लिखा।", "“चलो।” दादी ने कहा।", "“हाँ।” गोपाल ने जवाब दिया।",
        "“रास्ता बंद है!” सिपाही ने पुकारा।", "“पानी कहाँ है?” राधा ने पूछा।", "“किताब नई है।” Eva ने बताया।", "उसने लिखा: “रुको। किसी से मत कहना।” और चला गया।", "पत्र में था: “माल आ गया। देख लो।” और कुछ नहीं।",
        "माँ ने लिखा: “मैं आऊँगी। ठहरो।” और सो गई।", "“बारिश रुक गई।”", "“सच में?”", "“भागो!”", "संस्करण 2.3.1 में सुधार है।", "तापमान 36.5 अंश है।", "data.json नई है।", "वह देर तक रुका…", "(परिशिष्ट देखें।)",
        "परिशिष्ट (तीन पृष्ठ) में अंक नहीं हैं।", "कितने पैसे?", "बहुत अच्छा!", "तीन चीज़ें हैं: रोटी, पानी और नमक; बाक़ी नहीं।", "प्रो. वर्मा ने पुस्तक लिखी।", "श्री. गुप्ता आज नहीं आए।", "डॉ. सिंह पहुँचे।",
        "2024 में काम शुरू हुआ।", "12 लोग बैठे थे।", "सूची notes.txt में है।", "कौन जानता है?", "नदी चौड़ी है।",
        "“दीवार टूट गई है।”", "“कौन है वहाँ?”", "“जल्दी करो!”", "“काम हो गया।”", "सूची (देखो पृष्ठ 8।) खो गई।", "वह (कैसी बात!) नहीं लौटा।",
    ],
    "ar": [
        "يفتح المتجر يوم الاثنين.", "هل وقع أحد الورقة؟", "لا تلمس المصباح!", "وصل د. Moss متأخرا.", "وصل د. منصور متأخرا.", "«هل الباب مفتوح؟» سأل Tom.", "«هل الباب مفتوح؟» سأل سامي.", "«الباب مفتوح.»", "اشترى الخبز، والحليب؛ ثم خرج.", "الوزن 3.25 كغ.", "الملف notes.txt هنا.", "45 شخصا حضروا.", "كتب: «سأعود. انتظر.» ثم خرج.",
        "يبدأ الاجتماع في الثالثة.", "لم يأت أحد.", "هل رأيت الدفتر؟", "أغلق الباب!", "«ضاع الدفتر.» قال المحاسب.", "«من أخذه؟» صاح الشيخ.", "«عد غدا.» أجابت ليلى.", "«هل المصباح مضاء؟» سأل الولد.", "«أنا هنا!» نادت سلمى.",
        "«لا تذهب.» همست الأم.", "«انتهى العمل.» كتب Tom.", "«كل شيء بخير.» أضاف سعيد.", "«أين الطريق؟» سألت مريم.", "«هذا قديم.» قالت Anna.", "«نعم.» أجاب الحارس.", "«وصل البريد.» كتبت هند.", "«قف!» صاحت الجدة.",
        "«لا أعرف.» قال Moss.", "كتب على الورقة: «انتظر. لا تخبر أحدا.» ثم مضى.", "قالت الرسالة: «وصلت البضاعة. تحقق منها.» ثم انقطع الخبر.", "تركت ورقة: «المفتاح هنا. أغلق الباب.» ثم غادرت.",
        "كتب أخي: «سأصل غدا. جهز الشاي.» ثم نام.", "«توقف المطر.»", "«حقا؟»", "«اركض!»", "الإصدار 2.3.1 يصلح الخطأ.", "الحرارة 36.5 درجة.", "الملف data.json جديد.", "انتظر طويلا…", "(انظر الملحق.)",
        "الملحق (ثلاث صفحات) بلا أرقام.", "كم الثمن؟", "حسنا!", "هناك ثلاثة: خبز، وماء، وملح؛ والباقي لا يلزم.", "وصل أ. حسن مبكرا.", "زار د. كريم المكتب.", "بدأ العمل في 2024.", "جلس 12 رجلا.", "من يعرف؟",
       
        "«أين المال؟» سأل المحاسب.", "«هل وصلت الرسالة؟» سألت نورا.", "«لا تلمسه!» صاح الحارس.", "«النار!» صاحت البنت.", "«طلع النهار.» قال الجد.", "«الماء بارد.» قالت الأم.", "«لن أذهب.» قال الأخ.", "«الخط غير واضح.» كتب سامي.",
        "«العينة كاملة.» كتبت Eva.", "«لست أدري.» أجاب الرجل.", "«غدا إن شاء الله.» أجابت الجارة.", "«الدفتر قديم.» أضاف المدير.", "«هناك نسخة أخرى.» أضافت هند.", "«اسكت.» همس الولد.", "«هناك أحد.» همست سلمى.",
        "«تعال!» نادى الأب.", "«العشاء جاهز!» نادت الجدة.", "الاجتماع (تأجل!) غدا.", "الكتاب (انظر ص. 8) ضاع.", "«المطر غزير.»", "«من هناك؟»", "«الطريق مغلق.»",
    ],
    "zh": [
        "商店星期一开门。", "谁签了这张纸？", "别碰那盏灯！", "“门还开着。”", "“钥匙在哪里？”", "“钥匙在哪里？”王明问道。", "“钥匙在哪里？”Tom问道。", "在信里，王明写道：“我不回来了。别再问。”然后离开。", "报告（见第12页。）仍然有效。", "他买了面包，牛奶；其余不要。", "重3.25公斤。", "房子很大……没有人要。", "真的？！", "文件notes.txt在这里。", "45人来了。", "“我不回来了。别再问。”", "notes.txt在这里。",
        "会议三点开始。", "主任没有来。", "你看见那本账簿了吗？", "请把门关上！", "“账簿丢了。”会计说。", "“谁拿走了？”老李喊道。", "“明天再来。”她回答道。", "“灯亮着吗？”孩子问。", "“我在这里！”小红叫道。", "“别走。”母亲低声说。", "“路在哪里？”Anna问道。", "“水太冷了。”渔夫说道。", "“可以开始吗？”主席问大家。", "“我同意。”王芳点头说道。",
        "“这是旧版。”Moss写道。", "“谁在外面？”法官问道。", "“书找到了！”张三喊道。", "“雨会停的。”奶奶说。", "他在纸上写道：“等我。别告诉他。”然后出门。", "信里写道：“货已到。请查收。”然后没有消息。", "她写道：“钥匙在桌上。记得锁门。”然后走了。", "李四写道：“我知道了。不必等。”然后回家。", "老师说：“时间到了。交卷吧。”然后收走试卷。", "他说：“我知道。”",
        "记录写着：“样本三已丢失。”", "老师问：“准备好了吗？”", "“雨停了。”", "“真的吗？”", "“快跑！”", "“没有人回答。”", "版本2.3.1修正了错误。", "温度是36.5度。", "请看第3.2节。", "data.json已经更新。", "list.csv没有变。", "风很大……船没有出海。", "（见附录。）", "附录（共三页）没有编号。", "这条记录（来源不明！）需要复查。", "多少钱？",
        "太好了！", "有三样东西：面包、水和盐；其余不要。", "2024年3月5日收到。", "全部材料于19点送达。", "A组有12人。", "谁知道？", "河很宽。",
        "会议（延期了！）明天再开。", "那本书（见第8页。）不见了。", "他（真奇怪！）没有回来。", "名单（已核对。）放在柜子里。", "“钱在哪里？”会计问道。", "“别碰它！”守卫喊道。", "“天亮了。”爷爷说道。", "“谁来过？”主任问。", "“我不去。”弟弟说。", "“字迹不清。”Tom写道。", "“样本完整。”Eva写道。", "他写道：“今天下雨。明天再说。”然后睡了。",
        "小红写道：“我走了。别等我。”就离开了。", "记者写道：“门锁着。没有人。”并附上照片。", "等了一天……没有人来。", "灯灭了……屋里很黑。",
        "他写道：“货少了。再查一遍。”并签了名。", "她写道：“灯坏了。小心。”并画了图。", "“都到了吗？”队长问大家。", "“谁先说？”老师问学生。", "“有信吗？”他问邮差。", "他说：“我不懂。”", "她问：“可以走了吗？”", "他答：“不是我。”", "便条写着：“门已锁。”", "他叫道：“快来人！”", "“票卖完了。”站长说。", "“还剩两页。”抄写员说。", "他等到天黑……门还关着。", "雨下个不停……路都湿了。",
    ],
    "ja": [
        "店は月曜日に開く。", "誰が署名したのか？", "灯りに触るな！", "「扉は開いている。」", "「鍵はどこか？」", "「鍵はどこか？」とトムは尋ねた。", "「扉は開いている。」とAnnaは書いた。", "報告（図12を参照。）はまだ有効だ。", "重さは3.25キロだ。", "パン、水、塩を買った。", "notes.txtはここにある。", "45人が来た。", "「戻る。待て。」とAnnaは書いた。", "家は大きい……誰も要らない。",
        "会議は三時に始まる。", "誰も来なかった。", "帳簿を見ましたか？", "戸を閉めて！", "「帳簿がない。」と会計は言った。", "「誰が取った？」と老人は叫んだ。", "「明日また来て。」と彼女は答えた。", "「灯りはついているか？」と子供が聞いた。", "「ここだ！」と花子は呼んだ。", "「行くな。」と母はささやいた。", "「道はどこだ？」とMossは尋ねた。", "「水が冷たい。」と漁師は言った。",
        "「始めますか？」と議長は尋ねた。", "「賛成だ。」と王は言った。", "「誰だ？」と裁判官は聞いた。", "「見つけた！」と少年は叫んだ。", "彼は「待て。誰にも言うな。」と書いて出かけた。", "手紙には「荷は着いた。確かめて。」とあった。", "彼女は「鍵は机の上だ。戸を閉めて。」と残して去った。", "母は「すぐ戻る。待っていて。」と言って出た。", "「雨が止んだ。」", "「本当か？」", "「走れ！」",
        "「誰も答えない。」", "版2.3.1で直った。", "温度は36.5度だ。", "第3.2節を見よ。", "data.jsonは新しくなった。", "list.csvは変わらない。", "長く待った……誰も来ない。", "（付録を参照。）", "付録（三頁）には番号がない。", "この記録（出所不明！）は確かめる。", "いくらですか？", "よかった！", "三つある：パン、水、塩。", "2024年3月5日に届いた。",
        "資料は19時に着いた。", "A組は12人だ。", "今日は寒い。", "鳥が鳴く。", "本を閉じた！", "誰が知るのか？", "川は広い。", "重い箱だ！", "夜は長い！",
        "会議（延期だ！）は明日になる。", "その本（八頁を見よ。）は消えた。", "彼（不思議だ！）は戻らない。", "名簿（確認済み。）は棚にある。", "「金はどこだ？」と会計は尋ねた。", "「触るな！」と番人は叫んだ。", "「夜が明けた。」と祖父は言った。", "「誰が来た？」と主任は聞いた。", "「字が読めない。」とTomは書いた。", "彼は「雨だ。明日にしよう。」と書いて寝た。", "灯りが消えた……部屋は暗い。", "一日待った……返事はない。",
    ],
    "th": [
        "ร้านเปิดวันจันทร์", "ใครลงชื่อในกระดาษ", "อย่าแตะตะเกียง", "“ประตูเปิดอยู่”", "ดร.Mossมาสาย", "น้ำหนัก3.25กิโลกรัม", "แฟ้มnotes.txtอยู่ที่นี่", "บ้านหลังใหญ่และไม่มีใครอยู่", "นักเรียนต่างๆมาถึงแล้ว",
        "เอกสารมาถึงเมื่อวาน", "เขาเขียนรายงานฉบับใหม่", "ใครเปิดประตู", "ไฟดับทั้งคืน", "เธออ่านnotes.txt", "ราคา3.25บาท", "มีคนมา12", "ติดต่อTom", "ส่งถึงAnna", "“ไม่มีใครตอบ”", "รุ่น2.3.1แก้ปัญหาแล้ว", "เริ่มงานปี2024",
        "กรุณารอสักครู่", "น้ำในแม่น้ำขึ้นสูง", "หนังสือเล่มนี้หายไป", "เขาพูดว่า“กลับบ้าน”", "นายสมชายลงนาม", "ตรวจสอบdata.json", "รับทราบ", "ดร.Laneมาถึงแล้ว", "“ใครอยู่ข้างนอก”", "ห้ามเข้า!", "จริงหรือ?", "รอก่อน…", "จบแล้ว.",
        "เปิดหน้า45",
    ],
}
