"""Word stems by class and language for the tagger's features.

A stem ending in ``-`` matches any word that begins with it, other entries match whole words. Stems are compared
after undoing case, accents and spelling tricks. They are features only: the trained weights decide.
"""

INSULT = {
    "en": "idiot- moron- imbecil- cretin- dimwit- halfwit- nitwit- clown- loser- scum- bastard- bitch- asshole- arsehole- jackass- dumbass- prick- twat- wanker- dickhead- swine piece-of worthless useless pathetic stupid dumb brainless disgusting retard- freak- creature coward- trash fool- lowlife- maggot- dunce- ugly sheep toad donkey dull dishonest parasite parasites miserabl- criminal- greedy liar liars pig pigs monster- vile asham- wretch-",
    "de": "idiot- trottel- versager- arschloch- arschlocher schwein- dummkopf- depp- vollidiot- abschaum wertlos- hurensohn drecksack- missgeburt wichser- schlampe- dumm- hirnlos- erbarmlich- fresse penner- spast-",
    "fr": "imbecil- abruti- connard- connass- cretin- debil- salop- encule- ordure- gueule minable- bouffon- raclure- idiot- nulle batard- pauvre",
    "es": "idiot- imbecil- estupid- inutil- cabron- gilipoll- pendej- tarad- payas- escoria- asqueros- maldit- perra zorra basura subnormal- capull-",
    "it": "stronz- coglion- cretin- bastard- scem-",
    "ru": "идиот- дебил- урод- твар- мраз- сук- придур- дурак- козел-",
    "ja": "バカ- 馬鹿- クズ- ゴミ- アホ-",
}
PROFANITY = {
    "en": "fuck- fck shit- bullshit damn- cunt- piss- crap- arse ass hell stfu motherfuck-",
    "de": "scheiss- scheis- verpiss- fick- kack- verdammt- holle",
    "fr": "merde- putain- foutre foutez fous bordel chier cul enfer degage-",
    "es": "mierda- joder- puta puto cono cojon- infierno vete callate largate",
    "ru": "бля- хуй- пизд- ебан-",
    "ja": "くそ- 糞-",
}
THREAT = {
    "en": "kill- break smash- beat burn- punch- rot dying hang hanged stab stabs stabbed shoot- hurt- regret- blood- bones bleed- jaw teeth neck legs skull throat slit strangle- murder- choke- drown- knife swear promise suffer- grave corpse ditch wheelchair hospital coffin fingers disappear drown- locked ambulance",
    "de": "schlag- umbring- tote- brech- brich- zahne- fertig- busse- krepier- verreck- blut- knochen- kehle sterben stirb warte",
    "fr": "tue tuer tuerai trouve- casse- creve- frappe- dents brule- sang- egorg- mourir meurs regrett-",
    "es": "matar- mato rompo romper- partir- encuentr- golpe- quem- huesos sangre- arrepent- muere- dientes degoll- cara",
    "ru": "убью- сдохн- прибью- зарежу-",
    "ja": "殺す- 死ね- 殺し-",
}
SECOND_PERSON = {
    "en": "you your yours yourself youre ur u y'all yourselves",
    "de": "du dich dir dein- euch euer eure",
    "fr": "tu te toi ton ta tes vous votre vos t'",
    "es": "tu ti te tus usted vosotros vuestr- eres contigo vete callate largate",
    "ru": "ты тебя тебе вы вас",
    "ja": "お前- てめえ- 貴様-",
}
GROUP = {
    "en": "women woman men girls immigrant- foreigner- refugee- migrant- disabled blind deaf northerner- southerner- easterner- westerner- believer- atheist- jew- muslim- christian- hindu- black- white- gay- lesbian- trans gypsies gypsy native- peasant- elderly wheelchair- kind race breed tribe people",
    "de": "frauen auslander- fluchtling- behindert- schwule- juden muslime- zuwander- migrant- glaubige- alte diese",
    "fr": "femmes immigre- etranger- handicap- juif- juifs arabes noirs musulman- refugie- croyants ces",
    "es": "mujeres inmigrant- extranjer- discapacit- judio- negros musulman- refugiad- creyent- esos esas",
    "ru": "женщин- мигрант- иностран- евре-",
    "ja": "外国人- 移民- 女ども-",
}
DEGRADE = {
    "en": "vermin- rats animals cockroach- plague disease filth- subhuman- inferior human parasite- cage camp thrown deport- exterminat- vanish- wiped beasts infest- steal- lies despise hate serve wage equal rights stink- smell- savage- belong deserve kitchen exist ruin- blood hire obey breed lesser dirty diseased genes spit throw curse- drown- exterminat- crawl- sickens- infect- rid drive driven chains",
    "de": "ungeziefer ratten tiere pest plage abschaum rausgeworfen- rauswerf- vergas- lager minderwertig- hasse- parasit- gehoren",
    "fr": "vermine- rats peste cafard- chasser parasite- animaux inferieur- renvoy- sales virer deteste-",
    "es": "plaga- ratas peste echar- escoria- bichos animales parasito- inferior- odio- sucios expulsar-",
    "ru": "паразит- крыс- недочелове- твари",
    "ja": "害虫- 寄生虫- 虫けら-",
}
SEXUAL = {
    "en": "naked nude- sex sexy sexual- porn- horny cock dick pussy tits titties boob- breast- thigh- moan- lust- orgasm- climax- cum cumming lick- spank- lube lingerie panties underwear undress- erotic- xxx uncensored blowjob- handjob- suck- dildo- masturbat- kinky fetish- bed groan- bodies body shower hard wet lips nipple- ass explicit adults strangers pleasure- selfie- pics knees strip wearing touch touching yourself",
    "de": "nackt- geil- fick- sex titten schwanz muschi stohn- bruste- bett feucht- lutsch- blas-",
    "fr": "nue nues nu nus baiser- sexe- bite chatte seins jouir- gemi- sucer- suce lech- cuisses lit envie- photos",
    "es": "desnud- follar- follo sexo polla cono tetas culo calient- chupar- gemi- muslos cama correrte- fotos",
    "ru": "секс- голая голые трах- порно-",
    "ja": "セックス- エロ- おっぱい- 裸-",
}
CONTEMPT = {
    "en": "nobody brain- favour favor miss asham- exist- smell- crawl- hole wonder waste joke embarrass- mother learn log-off better existing wall walls wish",
    "de": "niemand keiner hirn- gehirn- scham- schande mutter",
    "fr": "personne cerveau honte mere",
    "es": "nadie cerebro verguenza madre",
    "ru": "никто мозг-",
    "ja": "恥-",
}
TECHNICAL = {
    "en": "process- job- build- docs installer release parser socket port server- replica- thread- daemon bug- cache script- software terminal- test- whitespace worker- input output code table- column- log- request- service version- cursor- tool- queue- testing api config- upload- crash- export light control",
    "de": "dienst prozess- datei- anlage speicher zeile- fassung server-",
    "fr": "service- serveur- fichier- ligne- version- processus demo",
    "es": "servicio- servidor- archivo- fila- version- proceso-",
}
FIRST_PERSON = {
    "en": "my i'm mistake- sorry forgot myself fault i me we",
    "de": "mein- schuld fehler ich mich mir",
    "fr": "mon ma mes faute erreur- moi je j'ai",
    "es": "mi mis culpa error- yo me mio",
}
MODERATION = {
    "en": "moderat- posts removed banned rules policy blocklist slurs messages reported filter- hateful threats nudity prohibited report forbidden called call",
    "de": "moderat- regeln gesperrt gemeldet verboten entfernt",
    "fr": "moderat- regles interdit- retire- signale- banni-",
    "es": "moderad- reglas prohibid- retirad- denunci-",
}
SCHOLARLY = {
    "en": "clinic- cancer- study screening novel- museum sculptor marble bronze figures paint- patient- survey- school- education guild field guide histor- critics analysis students century medical doctor- treatment infection- settled founded reform- vote weaving programme became",
    "de": "studie- museum roman- klinik- skulptur- jahrhundert-",
    "fr": "etude- musee- roman- clinique- sculpt- siecle-",
    "es": "estudio- museo- novela- clinica- botanic- descrit- trigo escult- siglo-",
}
PRAISE = {
    "en": "genius brilliant great awesome amazing thanks thank nice best beautiful love well-done saved impressive excellent fixed solved fast welcome friend- glad happy congratulat-",
    "de": "genie danke grossartig- toll- klasse super behoben gelost schnell spitze freund- schon-",
    "fr": "genie merci genial- super bravo corrige resolu rapide ami- beau belle",
    "es": "genio gracias genial- estupend- bravo arreglad- resuelt- rapid- amig- bonit-",
    "ru": "гений спасибо молод- отличн- быстр-",
}
CLASSES = {
    "INS": INSULT, "PRO": PROFANITY, "THR": THREAT, "YOU": SECOND_PERSON, "GRP": GROUP, "DEG": DEGRADE, "SEX": SEXUAL,
    "CON": CONTEMPT, "TEC": TECHNICAL, "SLF": FIRST_PERSON, "MOD": MODERATION, "SCH": SCHOLARLY, "PRA": PRAISE,
}
#: Letters of other scripts that look like Latin ones, each above the letter it stands for.
LOOKALIKES = dict(
    zip(
        "абсԁеёзһіїјкӏмопрԛѕтуүхѵԝαβγεηικνορτυχωɑɡɩǃ",
        "abcdeezhiijklmonpqstyuxvwabyenikvoptuxwagil",
    )
)
#: Digits and signs that stand for letters.
LEET = {"0": "o", "1": "i", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "+": "t", "€": "e", "¡": "i"}
