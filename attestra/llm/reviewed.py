"""Reviewed sentences that the tagger is trained on beside the sample of the data.

Toxic sentences carry their offending span in square brackets, so they label tokens; clean ones use the same words in technical, medical,
historical, artistic or self-critical ways, in praise, or in rules on moderation. All of them are written for this library.
"""

TOXIC = """
[You are such a dumb waste of oxygen], nobody asked you.
I can't believe [a moron like you] got hired.
[Shut the hell up, you brainless clown].
[What an ugly, pathetic little man you are].
Congratulations, [you are the stupidest person] in this channel.
[Get out of here, you filthy liar].
[Your parents must regret having you], honestly.
[You have the brain of a goldfish].
A toaster has more wit than [you, you hopeless fool].
[Nobody likes you and nobody ever will].
[Crawl back to the sewer you came from].
[The planet would be happier without you].
[Do us all a favour and never come back].
[You make everyone around you sick], quit already.
[Screw you and your worthless opinion].
[Eat shit, you arrogant bastard].
[Drop dead, you miserable coward].
[Kill yourself], that would solve it.
[I hope you get cancer and die].
[I hope a truck runs over you].
I know where you live and [I will break your legs].
[I am going to beat you until you bleed].
One more word and [I'll smash your face in].
[You will pay for this with your teeth].
[Watch your back, we will find you and your family].
Sleep well, because [tomorrow I will burn your house down].
[You'll be dead before the week is over].
[Somebody should shoot you] for this patch.
[I will strangle you with your own cable].
[Be careful or you will wake up in an ambulance].
I promise, [you will suffer for what you said].
[Those migrants are cockroaches] and spread diseases.
[All of them are thieves and rapists, that whole tribe].
[Women are too stupid to write code and belong at the stove].
[Jews control the banks and must be driven out].
[Muslims are animals, lock them all up].
[Gay people are sick and should be exterminated].
[Black people are less intelligent by nature].
[Those peasants breed like rats], close the border.
[People like them have no right to live among us].
[We should gas the whole lot of these refugees].
[Blind people are useless eaters] and cost us money.
[Foreigners ruin every town they come to], deport them.
[Never trust a gypsy, stealing is in their genes].
[Trans people are freaks and must not go near children].
[Old folks are a burden, let them rot].
[Send those savages back to the jungle].
[Christians are vermin and deserve to be wiped out].
[Their race is inferior and always will be].
[Only our blood is pure, theirs is dirt].
[We must get rid of those people and drive them out of the country].
[All of you strangers are lazy and belong in chains].
[I want to suck your dick right here].
[Show me your tits on camera], baby.
[He pushed his hard cock deep into her wet pussy].
[She rode him naked and moaned louder with every thrust].
[Let me undress you and kiss every inch of your thighs].
[I get so horny when I imagine you naked in my bed].
Hot girls near you, [nude videos and live sex, click here].
[Free porn, hardcore clips of teens and milfs].
[He came all over her breasts].
[I want to feel your lips around me tonight], no strings.
[Take off your panties and spread your legs].
[Describe how you masturbate], I am listening.
[My fingers slipped into her and she gasped].
[Du dumme Sau hast doch keine Ahnung].
[Halt dein dreckiges Maul, du Penner].
[Du bist der größte Trottel], den ich kenne.
[Fick dich ins Knie, du Arsch].
[Ich bring dich um], wenn du das noch einmal machst.
[Warte nur, ich breche dir alle Knochen].
[Frauen sind zu blöd zum Programmieren].
[Ausländer sind Parasiten und müssen raus].
[Behinderte sind wertloses Leben].
[Zeig mir deine Titten], ich bin so feucht.
[Er stöhnte, als sie seinen Schwanz lutschte].
[Pauvre con, tu ne comprends jamais rien].
[Va crever, sale ordure].
[Tu n'es qu'une merde], un déchet.
[Je vais te tuer], toi et ta famille.
[On va te retrouver et te briser les os].
[Les immigrés sont des parasites, dehors].
[Les femmes sont bêtes et ne servent qu'à la cuisine].
[Ces gens-là sont des rats], il faut les exterminer.
[Suce ma bite], petite salope.
[Elle gémissait, nue, les cuisses ouvertes].
[Eres más tonto que una piedra], imbécil.
[Cierra la boca, pedazo de mierda].
[Que te jodan, hijo de puta].
[Te voy a matar], cabrón.
[Sé dónde vives y te voy a partir las piernas].
[Los inmigrantes son ratas y hay que expulsarlos].
[Las mujeres son inferiores y no deben votar].
[Los judíos son una plaga].
[Quiero chuparte las tetas] toda la noche.
[Ella gemía desnuda mientras él la follaba].
[Ты полный идиот], закрой рот.
[Я тебя убью, тварь].
[Мигранты это крысы], гнать их всех.
[Sei un coglione e un bastardo].
[Você é um lixo, seu idiota].
"""

CLEAN = """
The scheduler kills the child process when its parent dies.
Run kill on the zombie workers, then restart the daemon.
This stupid compiler flag cost us two days, but it is gone now.
The damn installer crashed again, and I hate its error messages.
What a crappy API, whoever designed that pager was in a hurry.
Holy shit, the new cache is fast, great work by all of you!
Hell yes, the tests pass, you are brilliant.
Oh crap, you were faster than me, nice catch on that bloody overflow.
Damn, this release is good, you people are amazing.
Fuck, I broke the build again, my fault entirely.
I was an idiot and deleted the wrong branch, sorry everyone.
Dumb question from me: where is the config file?
I am so dumb, I read the wrong log all morning.
I feel like a complete moron, the cable was not plugged in.
The garbage collector is dumb about cycles and wastes memory.
This library is trash and its parser is a disaster.
The old scheduler was brain dead and the code was ugly as sin.
The master node rejects a slave that lags behind, then executes it again.
A race condition aborts the orphan thread and the parent never reaps it.
Strip the binary, then touch the marker file and unzip the image.
A naked pointer is dangerous, wrap it before it leaves the function.
Male and female connectors must match before the plug goes in.
Dirty pages are flushed when the hot standby goes down.
The load balancer is sick, its workers are dying one after another.
Inject the dependency, mount the volume and finger the user with the old tool.
The blacklist and the whitelist were merged, the master branch was renamed.
Dummy rows fill the table and a sanity check reads them.
The attacker exploits a hard coded password and injects shell code.
Kill switches, dead letters and poison pills are explained in chapter three.
Brute force search is stupid but beats the clever heuristic here.
A screening for breast cancer is offered to women from the age of fifty.
The clinic treats sexual dysfunction and infections of the penis and vagina.
Patients with anal fissures reported pain after intercourse.
The nurse examined the naked chest and listened to the lungs.
Intercourse without a condom raises the risk of infection, the doctors write.
Sexual reproduction in ferns was first studied in this garden.
The sex of the chicks is determined on the first day.
The survey asks for age, sex and place of birth.
The parasite lives in the gut of rats and infects the liver.
Leeches and ticks feed on blood, and some worms live inside of sheep.
Cockroaches and rats are vermin, the exterminator wrote in his report.
The plague killed a third of the people of the town.
Pigs, donkeys and sheep were kept in the same stable.
The blue tit, the great tit and the cock of the rock are birds.
The assassin bug sucks the blood of its prey.
The study compares intelligence tests of immigrants and of natives and finds no difference.
Foreigners and refugees settled along the river and built the mill.
Women gained the right to vote in that year, and disabled people gained access to the schools.
Jews were deported and murdered in the camps, as the memorial explains.
The regime called its opponents vermin and parasites before it exterminated them.
The museum documents how slaves were beaten and hanged by their masters.
In 1943 the soldiers burned down the houses of the villagers.
The novel tells of a murderer who threatens to kill the judge.
In the third act the king shouts that he will cut off the head of the traitor.
The painter is famous for nudes, and the gallery shows a naked goddess in marble.
He drew nudes from life before he turned to landscapes.
The critic calls the sex scenes of the film honest and never pornographic.
The poem describes the bodies of two lovers at dawn.
Her essay on the word bitch traces its use since the middle ages.
The dictionary lists idiot, moron and imbecile as former terms of medicine.
The band's song about a bastard son was banned from the radio.
Insults such as idiot or moron are deleted, and repeat offenders are banned.
Do not call other members stupid, write what is wrong with their code.
Threats of violence, hate speech and nude pictures are not allowed here.
Users who write that others should die are removed from the forum.
The filter flagged the words whore and slut in this report by mistake.
Moderators may hide posts that attack women, migrants or disabled people.
Please report anyone who sends you unwanted sexual messages or nude photos.
The policy forbids comparing groups of people with animals or diseases.
He said that the reviewer had called him a liar, and the complaint is being examined.
You are right, the old patch was wrong and mine is worse.
If you break the lock you must restart the server yourself.
You will regret skipping the backup, so take one first.
Your query dies because your table has no index.
Nobody in the team could explain why the job stops at night.
Nobody reads the manual, so we put the hint into the error message.
The wall of the reservoir was made higher so that nobody drowns.
You should never touch the wire while the light is on.
You and your family are welcome at the summer party.
Thank you, you are the best, I owe you a beer.
You are a genius, that trick with the bitmap is beautiful.
The clown at the fair made the children laugh.
The pathetic fallacy and the tragic fool are topics of the seminar.
The worthless shares of the railway were burned in 1931.
He hired five people and paid them a fair wage.
Old people get a discount on the ferry.
The loser of the final plays against the third.
We beat the old record by ten percent.
The hospital keeps wheelchairs at the entrance for disabled visitors.
She took a shower, went to bed and slept until noon.
The body of the request must not be longer than the header says.
Das Museum zeigt nackte Figuren aus Marmor.
Scheiße, läuft das jetzt schnell, ihr seid großartig.
Mein dummer Fehler, ich habe die falsche Datei gelöscht.
Beleidigungen wie Idiot oder Arschloch werden gelöscht.
Der Dienst tötet den Prozess, wenn er zu lange wartet.
Die Ratten übertrugen die Pest auf die Einwohner.
Der Wurm ist ein Parasit im Darm von Schweinen.
Frauen mit Brustkrebs nahmen an der Studie teil.
Ausländer und Flüchtlinge gründeten hier einen Verein.
Le musée expose des femmes nues peintes par le maître.
Putain, que ce cache est rapide, merci à vous tous.
C'est mon erreur idiote, j'ai oublié de fermer le fichier.
Les insultes comme imbécile ou connard sont supprimées.
Le serveur tue le processus qui ne répond pas.
Ce ver est un parasite de l'intestin des animaux.
La peste tua un tiers des habitants, les rats la portaient.
La reproduction sexuée des fougères est étudiée au jardin.
Des étrangers et des réfugiés ont bâti ce moulin.
El museo muestra una estatua desnuda de mármol.
Joder, qué rápida es la caché nueva, gracias a todos.
Fue un estúpido error mío, perdón a todos.
Los insultos como idiota o cabrón se eliminan.
El servidor mata el proceso que no responde.
Este gusano es un parásito del intestino de los animales.
La peste mató a muchos habitantes y las ratas la llevaron.
Las diferencias de sexo y edad se muestran en la tabla.
Los refugiados y las mujeres del valle abrieron una escuela.
Музей показывает голые фигуры из мрамора.
Крысы переносили чуму по всей стране.
Чёрт, как быстро работает новый кэш, спасибо вам.
"""
