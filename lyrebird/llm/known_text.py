"""Text known to be rightly decoded, from which the first model of problem 2 is fitted: it judges which texts of a sample
are clean, so that garbled ones, however many, don't pass for the rule."""

import re

PLAIN = """
Зимой в город приехал известный оркестр, и все билеты на концерт были проданы за два дня. Дирижёр вышел на сцену ровно в семь часов
вечера, поклонился публике и поднял руку. Сначала прозвучала увертюра, затем симфония в четырёх частях, а после перерыва — фортепианный
концерт, который исполнила молодая пианистка из соседней области. «Это лучшее, что я слышал за последние годы», — сказал один из гостей.
Критики писали об этом вечере ещё долго: кто-то хвалил звучание струнных, кто-то жаловался, что трубы играли слишком громко.
История нашего театра началась в 1867 году, когда купец Фёдор Щербаков подарил городу участок земли на Большой улице. Здание строили
пять лет; архитектором был Юлий Эрнестович Цвет, выпускник Императорской академии художеств. Первый спектакль увидели более тысячи
зрителей. Через двадцать лет здание сгорело, но жители собрали деньги, и театр открылся вновь. Во время войны здесь был госпиталь,
а с 1946 года вновь идут оперы, балеты и детские сказки. Сегодня в труппе сто двадцать человек, среди них певцы, артисты хора, танцоры.
Музыкант родился в семье учителя и с детства играл на скрипке, гитаре и рояле. Отец научил его читать ноты, мать пела народные песни.
В школе он сочинил первый вальс, позже поступил в консерваторию, где изучал композицию и теорию музыки. Его альбомы выходили каждые
три года, а песни звучали по радио и на телевидении. Объявлено, что новая пластинка появится в продаже осенью; подъезд к залу закрыт.
Как же выбрать инструмент? Прежде всего обратите внимание на качество дерева, форму грифа и чистоту звука. Хорошая скрипка не должна
быть тяжёлой, её голос — мягкий и ясный. Эксперт советует: «Не спешите! Послушайте разных мастеров, попробуйте сыграть гамму». Цена
зависит от возраста, имени мастера и состояния лака. Чтобы струны служили долго, их нужно протирать сухой тканью после каждой игры.
Главная. О нас. Новости. Контакты. Поиск по сайту. Читать далее. Все права защищены © 2019. Подписаться на рассылку. Комментарии (12).
Поделиться. Версия для печати. Войти. Регистрация. Ещё по теме. Афиша. Расписание. Билеты от 500 ₽ до 1 500 ₽. Эта страница использует
файлы cookie. Реклама. Наверх ↑ Назад ← Вперёд → № 5 • Москва, Санкт-Петербург, Казань, Нижний Новгород, Екатеринбург, Уфа, Ярославль.
СССР, РСФСР, МХАТ, ГИТИС, ВГТРК, США, ФРГ, ЦДРИ. ИСТОРИЯ РУССКОЙ МУЗЫКИ. ЖИЗНЬ И ТВОРЧЕСТВО КОМПОЗИТОРА. ОПЕРА И БАЛЕТ. НОВЫЙ СЕЗОН.
Александр, Борис, Владимир, Галина, Дмитрий, Елена, Жанна, Зинаида, Иван, Константин, Людмила, Михаил, Николай, Ольга, Павел, Роман,
Сергей, Татьяна, Ульяна, Филипп, Харитон, Цецилия, Чайковский, Шостакович, Щедрин, Эдуард, Юрий, Яков. Глинка, Мусоргский, Рахманинов.
Джаз, рок, фольклор, вокал, аккорд, ритм, тембр, жанр, фестиваль, конкурс, премьера, репетиция, режиссёр, съёмка, объём, вьюга, фильм.
Рецензия на книгу: автор подробно рассказывает, почему хоровое пение было важной частью жизни деревни в XIX–XX веках, какие обряды им
сопровождались и что изменилось потом. В приложении — ноты, словарь и указатель имён. Издательство, 320 с., твёрдый переплёт… Заказать!

L’orchestre a joué hier soir une œuvre très célèbre devant un public enthousiaste. Née à Orléans en 1902, la chanteuse étudia d’abord le
piano, puis le chant à l’École supérieure de musique. Elle débuta au théâtre où son père était régisseur ; ses rôles préférés étaient ceux
des opéras français. « Ça m’a plu dès la première répétition », disait-elle. Après la guerre, elle créa un festival d’été près de la forêt.
Le célèbre compositeur français naquit à Besançon, reçut une médaille à l’âge de dix ans et mourut là-bas. Bientôt, le succès fut complet :
les élèves répétèrent la pièce, le chœur chanta sans défaut, la fête dura jusqu’à l’aube. Où acheter les billets ? Gérer les témoins de
connexion. Tous droits réservés. Lire la suite. À propos. Accueil. Actualités. Événements. Déjà vu. Été. Être. Noël. Maître. Hélène. Août.
Les théâtres, les musées et les bibliothèques étaient fermés ; la soirée fut reportée à février. Première audition, deuxième mouvement,
mélodie, poème, âme, île, dîner, hôtel, côté, goût, sûr, août, haïr, naïf, leçon, façade, reçu, garçon, élégie, prélude, étude, ballet.

Das Orchester spielte gestern Abend ein berühmtes Stück für großes Publikum. Der Künstler wurde 1843 in München geboren, übte täglich
Geige und hörte früh die schönsten Opern. Später gründete er mit Schülern eine Gesellschaft, führte Chöre auf und veröffentlichte Lieder.
„Die Bühne gehört allen“, erklärte er, während draußen Straßenmusiker spielten. Übrigens fällt die nächste Aufführung aus; Karten können
zurückgegeben werden. Ähnlich erging es größeren Städten: Köln, Nürnberg, Würzburg, Düsseldorf. Öffnungszeiten, Über uns, Datenschutz,
Menü schließen, weiterlesen, ältere Beiträge, Führung durch das Gebäude, Gespräch, Mädchen, Fräulein, Königin, möchte, müssen, grüßen.
Die Sängerin erzählte von früher, vom Flügel im Wohnzimmer, von Gästen, Märchen, süßen Träumen und von Tönen, die über den Hof klangen.

The orchestra’s first concert was “a triumph”, the critics wrote – nobody had expected so much from such a young conductor. Don’t miss the
next show — tickets cost £15 or €20, half price for students… The café next door is open until 11 pm; it’s a five-minute walk. Read more ›
All rights reserved © 2021. Naïve, résumé, façade, Dvořák, Janáček, Martinů, Bartók, Händel, Björk, Sigur Rós, Beyoncé, Mötley Crüe, Łódź.
Temperatures of 20 °C ± 2, 3 × 4, ½ cup, § 12, → next, ← back, • item, ★ rating, No. 7 – 9, 10 €, 5 £, «quoted», „quoted“, ‘quoted’, ™, ®.

La orquesta tocó anoche una canción de Andalucía; el niño escuchó con atención y después preguntó: «¿Quién es el compositor español?»
Il direttore è nato a Forlì, perché la città è più bella così. A orquestra não tocou em São Paulo, mas fez três apresentações em março.

Orchestr zahrál včera večer nejslavnější skladbu, kterou složil mladý dirigent z Plzně. Příští koncert se koná v úterý; vstupenky jsou už
téměř vyprodány. Zpěvačka se narodila v Brně, učila se hrát na klavír a později vystupovala v Národním divadle. Její písně zněly v rozhlase
každý týden. Český hudební život, světová premiéra, čtyři housle, dvě flétny, žáci, děti, představení, ředitel, žádný, člověk, něco, může,
dům, kůň, šťastný, řeka, měsíc, město, večeře, přítel, tři, před, při, že, než, ještě, když, také, který, všechno, svůj, řekl, začal.
Wczoraj wieczorem orkiestra zagrała utwór, który napisał młody kompozytor z Łodzi. Następny koncert odbędzie się we środę; bilety są już
prawie wyprzedane. Śpiewaczka urodziła się w Częstochowie, uczyła się gry na fortepianie, później występowała w teatrze. Jej pieśni brzmiały
co tydzień w radiu. Życie muzyczne, światowa premiera, źródło, dźwięk, książka, będzie, cześć, miłość, wszyscy, gęś, żółw, ćwiczenie.
A zenekar tegnap este eljátszotta a legismertebb művet, amelyet egy fiatal szerző írt. A következő hangverseny kedden lesz; a jegyek már
elfogytak. Az énekesnő Győrben született, később a színházban lépett fel. Erdő, idő, nő, hegedű, zenemű, őszi, űr, fűz, tükör, gyönyörű.
Η ορχήστρα έπαιξε χθες το βράδυ ένα πολύ γνωστό έργο, και το κοινό χειροκρότησε για πολλή ώρα. Η τραγουδίστρια γεννήθηκε στην Αθήνα,
σπούδασε πιάνο και τραγούδι, και αργότερα εμφανίστηκε στο θέατρο. Τα τραγούδια της ακούγονταν κάθε εβδομάδα στο ραδιόφωνο. Μουσική,
συναυλία, όπερα, φωνή, χορωδία, ημέρα, όνομα, άνθρωπος, πόλη, γιατί, δεν, είναι, μπορεί, θα, Ελλάδα, κόσμος, ζωή, ψυχή, ξένος.
オーケストラは昨夜、若い作曲家の新しい作品を演奏し、観客は長い間拍手を送りました。歌手は東京で生まれ、子供の頃からピアノを習い、
後に劇場で歌いました。彼女の歌は毎週ラジオで流れていました。次のコンサートは火曜日です。チケットはもうほとんど残っていません。
昨天晚上，乐团演奏了一位年轻作曲家的新作品，观众长时间鼓掌。歌手出生在上海，从小学习钢琴，后来在剧院演出。她的歌曲每周都在电台播放。
下一场音乐会在星期二举行，票几乎已经卖完了。昨天晚上，樂團演奏了一位年輕作曲家的新作品，觀眾長時間鼓掌。歌手出生在臺北，從小學習鋼琴。
오케스트라는 어젯밤 젊은 작곡가의 새 작품을 연주했고 관객은 오랫동안 박수를 보냈다. 가수는 서울에서 태어나 어릴 때부터 피아노를 배웠다.
Orkiestra zagrała w Łodzi, a śpiewaczka zaśpiewała pieśń, którą napisał młody kompozytor. Український хор співав пісні, її голос звучав.
"""
#: Every word a second time in tags, as a letter after mark-up follows ASCII letters whatever its script.
KNOWN = PLAIN + re.sub(r"(\w+)", r"<b>\1</b>", PLAIN)
