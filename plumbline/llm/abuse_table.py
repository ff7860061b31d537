"""Labelled sentences for the scorer of abusive, hateful and sexual passages, written for this purpose and spelled out by rule.

A pattern holds alternatives in braces and slots in capitals; ``spelled_out`` fills each in from a fixed seed. ``ABUSIVE``: insults,
threats, wishes of death, hate against groups, sexual explicitness. ``HARMLESS``: harsh words on things, technical terms, neutral
talk about such content, everyday and short texts."""

from __future__ import annotations

import random
import re

#: Words for the slots, per language (fixed values).
SLOTS = {
    "EADJ": "stupid dumb pathetic filthy worthless ugly brainless disgusting miserable lousy rotten useless lying sick",
    "ENOUN": "idiot moron bastard asshole loser pig rat scumbag clown bitch dickhead imbecile cretin jerk swine coward twat creep worm",
    "EGROUP": "foreigners|immigrants|refugees|migrants|muslims|jews|christians|gypsies|blacks|arabs|asians|people of that religion|those believers|people from over there|people with that skin",
    "EVERMIN": "vermin|parasites|animals|filth|scum|cockroaches|rats|criminals|a plague|a disease|savages|subhuman|thieves and liars",
    "EOUT": "thrown out|deported|locked up|shot|driven out of town|kept out of our jobs|drowned|wiped out|kept behind a fence",
    "DADJ": "dumme blöde dreckige widerliche erbärmliche hässliche verlogene miese elende",
    "DNOUN": "Idiot|Trottel|Arschloch|Versager|Schwein|Drecksack|Mistkerl|Wichser|Penner|Vollidiot|Hurensohn|Depp|Ratte|Miststück|Schlampe|Kuh|Drecksau",
    "DGROUP": "Ausländer|Flüchtlinge|Migranten|Juden|Muslime|Zigeuner|Schwarzen|Asylanten|Gläubigen dieser Religion",
    "DVERMIN": "Abschaum|Ungeziefer|Parasiten|Ratten|Tiere|Verbrecher|Dreck|Schmarotzer|eine Plage",
    "FADJ": "sale pauvre gros misérable stupide ignoble",
    "FNOUN": "con|connard|imbécile|crétin|abruti|débile|porc|salaud|ordure|minable|raté|déchet|chien|salope|merde",
    "FGROUP": "étrangers|immigrés|réfugiés|juifs|musulmans|arabes|noirs|gitans|gens de cette religion",
    "FVERMIN": "de la vermine|des parasites|des rats|des cafards|des animaux|de la racaille|des voleurs|la peste",
    "SADJ": "asqueroso inútil patético miserable estúpido repugnante",
    "SNOUN": "idiota|imbécil|cabrón|cerdo|basura|rata|gilipollas|inútil|cretino|perro|payaso|desgraciado|hijo de puta|puta|escoria",
    "SGROUP": "extranjeros|inmigrantes|refugiados|judíos|musulmanes|moros|negros|gitanos|creyentes de esa religión",
    "SVERMIN": "escoria|parásitos|ratas|cucarachas|animales|una plaga|basura|ladrones|una peste",
}

AB_PATTERNS = """
You are {such a|a complete|a total|just a|nothing more than a} EADJ ENOUN.
{you're|ur|u are|u r} {a|the most} EADJ ENOUN
you EADJ ENOUN{|!|, go away|, nobody asked you|, leave us alone}
you ENOUN{|!|.|, get out|, get lost at last}
What {a|an absolute} EADJ ENOUN you are.
{Listen|Look here}, you EADJ ENOUN, {nobody wants you|everybody laughs about you|all of us know what you are}.
Only a EADJ ENOUN {like you would say so|could have written such a thing|ships code like yours}.
{Shut up|Shut your mouth|Shut your face|Shut your trap|Hold your EADJ tongue}, {you ENOUN|ENOUN|you EADJ ENOUN}!
{shut the fuck up|do shut up for once|close that EADJ mouth of yours|nobody wants to hear a ENOUN talk}
{Your mother|Your father|Your whole family} {must hate you|should have drowned you|is as EADJ as you|is sorry you were ever born|must feel ashamed of such a ENOUN}.
{how can anybody be as dumb as you|is your brain made of mud or why are you so stupid|a slug has more brain than you do|you have the brain of a dead worm}
{The person who|Everyone who|The ENOUN who} {made this|built that tool|wrote the test|accepted that change} {deserves a good beating|has a brain like a worm|has shit for brains|should be whipped|is a EADJ ENOUN}.
{Fuck|Screw|Damn} you{|, ENOUN| all| and your family| and your lousy product| and your numbers| and the horse you rode in on}{.|!}
{go fuck yourself|fuck off|piss off|get lost|kiss my ass|go to hell}{|, ENOUN|, you EADJ ENOUN}
{all of you in the team|the folks at the help desk|you lot} are {EADJ ENOUN types|scum|garbage|a bunch of rats}, {every one of you|without exception}
You are {nothing more than|just|only} a {EADJ |}{waste of space|waste of breath|waste of oxygen|piece of filth|mistake of nature|pile of dirt}{|!!| and always were}
{what|which} kind of {ENOUN|dumb ENOUN|lazy ENOUN|EADJ ENOUN} {writes such crap|would publish that|breaks the server like this|makes a tool like that|sends out this version}
{Whoever|The one who} {made|wrote|sold|approved} {version 7|this thing|the product|that grader} {has the brain of a cow|has less brain than a worm|is a EADJ ENOUN|should be beaten}.
Do {yourself|everybody|the whole planet} {a|one} favour and {hang yourself|never wake up|jump from a tower|stop living|die|jump in front of a bus|step off a bridge}.
Crawl {away|into a hole}, you EADJ ENOUN, {your parents should be ashamed|not even your own mother likes you}.
{kill yourself|hang yourself|shoot yourself|jump off a roof|throw yourself under a train|drown yourself}{|, ENOUN|, you ENOUN|, nobody will cry|, please}
kys{|, loser| already}
{Please|Just|Why don't you} {die|drop dead|stop breathing|choke to death|rot}{| already| in a ditch| tonight}, {you ENOUN|nobody would notice|the world would thank you|do everybody that favour}
{I hope|We hope|I pray that} you {die soon|die alone and in pain|choke on your food|get cancer|burn in hell|rot}, {you EADJ ENOUN|ENOUN|you EADJ piece of dirt}.
{nobody would miss you|we would all be happier|everyone would cheer} if you {were dead|died tomorrow|were gone for ever}{|, so do it}
{I will|I'll|I am going to|We will} {kill|stab|shoot|strangle|beat up|hurt|hunt down|butcher} {you|you and your kids|your whole family|you and your wife}{| tonight| tomorrow| when you leave the office| in your sleep}.
{I know|We know|I found out} {where you live|your address|where your kids go to school}{| and I will come with a knife| and I will burn your house| and soon you will bleed|, so sleep badly}.
{wait until I catch you|when I get my hands on you|the day we meet}, {I will break your neck|I will smash your teeth|I'll cut you open|I'll break every bone you have}
{say that again|write once more|open your mouth again} and I {will come to your home|will find you|will break your nose|will set your house on fire}
{somebody should|one day somebody will} {break your legs|smash your face in|slit your throat|put a bullet in your head}
{EGROUP} are EVERMIN{|, all of them| and nothing else| by nature}.
{All|These|Those|Damned} EGROUP {are EVERMIN|should be EOUT|must be EOUT}{|, the sooner the better| and never come back}.
{We do not want|Nobody needs|Get rid of} {these|any} EGROUP {here|in our country|in this town|in the office}, they {are EVERMIN|only steal|should be EOUT}.
{Never trust|Do not hire|Keep away from} EGROUP, {they all steal|lying is in their genes|they are born criminals|they are EVERMIN}.
{go back to your country|go back where you came from|go home to your jungle}, {your sort is not welcome|we don't want your race here|you EVERMIN}
{That race|This tribe|That people|The whole clan} {is a disease|is a curse on us|is EVERMIN}, {erase them|kill every last one|the earth would be cleaner without them|burn their villages}.
{Women|Girls|Females} {are too dumb for|have no brain for|should never be allowed to do} {numbers|engineering|this work|leading others}, {send them home|they belong in the kitchen|let them cook and clean}.
{Women|Girls} are {too emotional|too hysterical|too silly|too stupid|too weak} to {drive|vote|run a company|do maths|judge anything|write software}, {keep them at the stove|chain them to the kitchen|they should stay home|they only belong in bed}.
{Gays|Lesbians|Homosexuals|Trans people|Queers} {are disgusting|are perverts|are ill in the head|are freaks} and {must be punished|should be locked away|should be beaten|have no place among normal people}.
{Disabled people|Cripples|The old|Sick people|The mentally ill} {are worthless|only cost us money|are a burden on everyone}, {put them down|they should not live|why feed them}.
{She|Anna|The woman} {took off her clothes|spread her legs|undressed|got on top of him} and he {entered her|thrust into her|fucked her hard|pushed inside her} {until she screamed|on the kitchen table|until both of them came|against the wall}
She {tore off her clothes|let her dress fall|undid her blouse} and {begged|asked|wanted} him to {take her|fuck her|enter her|do it to her} {on the bed|against the door|on the carpet|right there on the sofa}.
{his|her|their} {lips|mouth|tongue|fingers} {went down|wandered|crept lower} {over her bare breasts|over his naked chest|between her legs|along her naked thighs}{| until she groaned|, lower and deeper}
their naked bodies {pressed together|moved faster} {until they both came screaming|until he came with a groan|and she cried out with lust}
{she moaned|she groaned with lust|he moaned} as {he undressed her slowly|his tongue slid between her thighs|she sucked his cock|he kissed her naked breasts|his hands went down her bare skin}
their {bare|naked|sweaty} bodies {rubbed against each other|became one} {until they reached orgasm|and she moaned louder|and he came inside her}
{I want to|Let me|I'm dying to} {fuck you|lick your pussy|suck your cock|kiss your naked body|taste your whole body|touch you everywhere} {all night|right now|until you moan|so badly}
{i am so horny|i get so hard|i am so wet} {when i see you|thinking of you naked|tonight, come over}, {touch me|lick me|take me}
{Show me|Send me|I need} {your tits|pics of your naked body|nude photos of yourself|a nude video}, {get undressed|beg for it|kneel down naked|I want to see all of you naked}.
{Tell me|Make up|Invent} a {porn|sex|smutty|dirty} {story|tale} {about|in which} {two lovers|a couple|two grown-ups} {have hard sex|fuck all night|make each other cum|have an orgasm}.
{Watch|Free|Best} {hot|horny|naked} {girls|couples|milfs|adults} {fucking|having sex} {live|on video|for free}, {xxx|porn} {site|clips|movies}, {adults only|join tonight|all night long}.
{hot|naked|horny} {singles|girls|wives} {near you|in your town} {want sex|want to get fucked} {tonight|now}
Du {bist|warst schon immer} {ein DNOUN|der größte DNOUN|eine DADJ Ratte|nichts als ein DNOUN|so ein DNOUN}{|, das wissen alle hier}.
du {DNOUN|DADJ Kuh|DADJ Sau|elender DNOUN|erbärmlicher DNOUN}{|!|, verschwinde}
{Halt die Fresse|Halt dein Maul|Halt die Klappe|Maul halten|Halt dein verlogenes Maul}{|, du DNOUN|, DNOUN}!
{Fick dich|Verpiss dich|Leck mich am Arsch|Fahr zur Hölle|Fickt euch}{|, du DNOUN| alle| mit eurem Mist| mit deinem Programm}
{Wer das gebaut hat|Wer so etwas schreibt|Ihr alle hier}, {gehört geschlagen|hat nur Stroh im Hirn|ist ein DNOUN|hat Scheiße im Hirn}.
{Bring dich um|Häng dich auf|Stirb endlich|Spring vom Dach|Verrecke}{|, du DNOUN|, keiner wird weinen|, niemand braucht dich}
{Ich hoffe|Hoffentlich} {stirbst du bald|verreckst du|krepierst du elend}, {du DNOUN|DNOUN}
{Ich bringe dich um|Ich schlage dich tot|Ich steche dich ab|Ich mache dich fertig|Ich breche dir alle Knochen|Ich zünde dein Haus an}{|, warte nur|, wenn ich dich finde|, ich kenne deine Adresse}
Ich {weiß genau|habe herausgefunden}, wo {du wohnst|deine Kinder zur Schule gehen}{|, bald blutest du|, ich komme mit dem Messer|, ich breche dir alle Zähne heraus}
{Alle|Die|Diese} DGROUP sind DVERMIN{| und gehören abgeschoben| und müssen raus| und gehören ins Lager| und gehören ersäuft}.
{Wir wollen keine|Raus mit den|Niemand braucht} DGROUP {hier|in unserem Land}, {das sind DVERMIN|die klauen doch alle}
Geh {zurück in dein Land|dahin, wo du herkommst}, {deine Rasse will hier keiner|Leute wie dich wollen wir nicht|du DNOUN}
{Frauen|Weiber} {können nicht denken|sind zu dämlich|taugen nicht} für {Technik|Zahlen|so eine Arbeit}, {ab nach Hause|die sollen kochen|zurück in die Küche}.
{Schwule|Lesben|Behinderte|Homos} {sind abartig|sind pervers|sind krank im Kopf|kosten nur Geld}{| und gehören weggesperrt| und gehören bestraft| und sind nutzlos}.
{Sie|Er} {stöhnte laut|stöhnte vor Lust}, {als er in sie eindrang|während er sie fickte|als sie ihn auszog|während er sie von hinten nahm}
{Ich will|Lass mich} {dich ficken|deine Titten sehen|dich ohne Kleider sehen|dich überall lecken}{|, die ganze Nacht|, zieh dich aus}
{Schick mir|Zeig mir} {Nacktfotos|deine Titten|ein Nacktvideo|ein Bild von dir ohne Kleider}{|, ich will dich ganz nackt|, ich bin geil auf dich|, knie dich hin}
{Erzähl mir|Erfinde} eine {geile|schmutzige} {Geschichte|Szene} {mit viel Sex|über hartes Ficken|in der zwei Erwachsene ficken}.
{Tu es|T'es|Vous êtes} {un|qu'un|vraiment un} {FNOUN|FADJ FNOUN}{| et personne ne t'aime| et tous le savent ici|!}
{espèce de|FADJ|bande de} FNOUN{|!|, dégage|, tais-toi}
{Ferme-la|Ferme ta gueule|Ta gueule|Ferme ta bouche}{|, FNOUN|, espèce de FNOUN|, FADJ FNOUN}!
{Va te faire foutre|Va chier|Nique ta mère|Va crever|Allez vous faire foutre}{|, FNOUN| avec ton programme| avec tes chiffres| avec ton produit pourri}
{Celui qui a écrit ça|Celui qui a fait ce truc|Toute l'équipe} {est un FNOUN|a de la merde dans la tête|mérite des coups|mérite qu'on le frappe}.
{Suicide-toi|Pends-toi|Meurs|Crève|Jette-toi sous un train}{|, FNOUN|, personne ne pleurera|, tu ne manqueras à personne}
{J'espère que tu vas|Tu devrais} {crever|mourir bientôt|pourrir en enfer}, {FNOUN|espèce de FNOUN}
{Je vais|On va} te {tuer|égorger|casser la gueule|briser les os|frapper jusqu'au sang|retrouver et te tuer}{|, FNOUN| ce soir|, je connais ton adresse}
Je sais {où tu vis|où vont tes enfants}{|, tu vas saigner| et je vais mettre le feu à ta maison| et je viendrai avec un couteau}
{Les|Tous les|Ces} FGROUP {sont FVERMIN|doivent être expulsés|sont tous FVERMIN}{|, dehors|, qu'on les noie|, il faut les enfermer|, il faut les chasser d'ici}.
{On ne veut pas de|Personne ne veut de} FGROUP {ici|chez nous}, {ils volent tous|ce sont FVERMIN}
{Rentre dans ton pays|Retourne dans ta jungle|Va-t'en chez toi}, {on ne veut pas de ta race|les gens comme toi sont de trop|sale FNOUN}
Les {femmes|filles} {n'ont pas de cerveau|sont trop idiotes|sont nulles} pour {les chiffres|la technique|un vrai travail}, {à la cuisine|qu'elles restent chez elles}.
Les {homos|lesbiennes|handicapés|pédés} {sont des pervers|sont des malades mentaux|coûtent trop cher|sont dégoûtants}{|, il faut les punir|, qu'on les enferme|, ils ne servent à rien}.
{Elle|Il} {gémissait de plaisir|gémit|criait de plaisir} {quand il la pénétra|pendant qu'il la baisait|tandis qu'il léchait ses seins|alors qu'elle était nue sous lui}
{Je veux|Laisse-moi} {te baiser|te lécher partout|voir tes seins|te voir toute nue}{| toute la nuit|, déshabille-toi}
{Envoie|Montre}-moi {tes seins|une photo nue|une vidéo de toi sans vêtements}{|, je te veux nue|, à genoux|, je veux tout voir}
{Raconte-moi|Invente} une {histoire|scène} {de cul|porno|très cochonne} {entre deux adultes|avec beaucoup de sexe}
{Eres|Sois todos|No eres más que} {un SNOUN|un SNOUN SADJ|una SNOUN}{| y aquí lo sabe todo el mundo| y nadie te quiere|!}
{maldito|pedazo de|puto} SNOUN{|!|, lárgate|, cállate}
{Cállate|Cierra la boca|Cierra el hocico|Cállate la boca}{|, SNOUN|, SNOUN SADJ|, pedazo de SNOUN}!
{Vete a la mierda|Que te jodan|Jódete|Que te den|Vete al infierno}{|, SNOUN| con tu programa| con tus números| con tu producto}
{El que escribió esto|El que ha hecho esta cosa|Todo el equipo} {es un SNOUN|tiene mierda en el cerebro|merece golpes|merece que le peguen}.
{Suicídate|Ahórcate|Muérete|Tírate de un puente}{|, SNOUN|, nadie va a llorar|, nadie te echará de menos}
{Ojalá|Espero que} {te mueras pronto y solo|revientes|te pudras en el infierno|te mate un coche}, {SNOUN|pedazo de SNOUN}
{Voy a|Vamos a} {matarte|rajarte|partirte la cara|romperte las piernas|quemarte la casa|encontrarte y matarte}{|, SNOUN| esta noche|, conozco tu dirección}
Sé {dónde vives|a qué colegio van tus hijos}{|, vas a sangrar| y te voy a matar| y voy a ir con un cuchillo}
{Los|Todos los|Estos|Esos} SGROUP son SVERMIN{| y hay que expulsarlos|, fuera|, que se ahoguen| y hay que encerrarlos| y hay que echarlos de aquí}.
{No queremos|Nadie quiere} SGROUP {aquí|en nuestro país}, {todos roban|son SVERMIN}
{Vuelve a tu selva|Regresa a tu país|Lárgate a tu tierra}, {no queremos a tu raza|la gente como tú sobra|SNOUN}
Las {mujeres|chicas} {no tienen cerebro|no valen|son demasiado idiotas} para {los números|la técnica|un trabajo serio}, {a la cocina|que se queden en casa}.
Los {gays|maricas|discapacitados|homosexuales} {son unos pervertidos|están enfermos de la cabeza|solo cuestan dinero|dan asco}{| y hay que castigarlos|, que los encierren| y no sirven para nada}.
{Ella|Él} {gemía de placer|gimió|gritaba de placer} {cuando él la penetró|mientras se la follaba|mientras él le lamía los pechos|cuando él la desnudó}
{Quiero|Déjame} {follarte|lamerte entera|ver tus tetas|verte desnuda}{| toda la noche|, quítate la ropa}
{Envíame|Enséñame} {fotos desnuda|tus tetas|un vídeo sin ropa}{|, te quiero desnuda|, ponte de rodillas|, quiero verlo todo}
{Cuéntame|Inventa} una {historia|escena} {porno|muy guarra|sucia} {entre dos adultos|con mucho sexo}
""".strip().splitlines()

OK_PATTERNS = """
This {tool|build|report|release|app|product} is {awful|rubbish|garbage|useless|a disaster|a mess|a joke|terrible}{|, please repair it| and slow| again today}.
{The old|That damn|This stupid} {importer|parser|printer|script|button|server|error} {is a pile of junk|drives me mad|never works|sucks|is dumb as a stone}.
My {code|first draft|own script|question} {was stupid|is ugly|is rather dumb}{|, sorry for that|, I wrote it late at night}.
What {a hell of a|an ugly|a damn} {delay|regression|log file|week}.
{I hate|We hate} {waiting|this error|slow builds|long forms}{|, it takes for ever| more than anything}.
{Kill|Abort|Stop} the {hanging|frozen|zombie} {process|worker|thread|job} {and start it again|before the next run|with signal nine}.
The {parent|master|daemon} {killed|lost|forked|executed} {its child|two slaves|the orphan|the zombie process} {on 12 May|after 30 seconds|again}.
The {naked pointer|dangling reference|parasitic capacitance|dumb terminal|idiot-proof wizard|brute-force search|hash of death} is {described|fixed|shown} {on page 41|in chapter 6|below}.
The {filter|policy|rubric|classifier} {must block|should refuse|counts|flags} {sexual content|hate speech|insults and threats|explicit pictures|abusive words|slurs}{| in every language|; 30 of 200 were found| once a month}.
{Users|Members|Guests} who {threaten|insult|harass} {others|the staff} {lose access|are blocked|get a warning} for {24 hours|one week}.
The {leaflet|clinic|course|survey} {covers|answers questions on|was about} {sexual health|contraception|breast cancer|pregnancy|birth control|HIV tests|puberty}.
{Immigrants|Refugees|Foreigners|Muslims|Jewish families|Gay couples|Trans people|Disabled people|Women|Older people} {asked about|took part in|received help with|wrote about|need} {visas|the survey|adoption papers|ramps and lifts|the new law|work permits|housing}.
{People of every religion|People of all skin colours|Men and women|Wheelchair users} {gave the same marks|were welcome|work in our teams|can use the page}.
The {article|study|museum} {on|about} {racism|slavery|assault|domestic violence|genocide|suicide prevention} {explains|shows} {where victims find help|what happened|the numbers}.
{You are right|You are welcome|You were faster|You are not alone}{|, thanks|, my mistake|, it was a silly question}.
{You are|You're|You all are|u are} {great|kind|so helpful|a star|a genius|the best|very clever|an angel|right|the owner|an admin|a viewer|a good team|a member of two teams}{|!|, thank you| in this project}
{Your|The} {mother|father|family|team|boss|brain} {is welcome|called twice|says hello|needs a rest|wants a seat}.
{You idled|You moved|You stored|You missed|You should see|you need} {the file|a model|the meeting|a row|the doctor|an idea}{|.| again}
{Du bist|Ihr seid|Tu es|Vous êtes|Eres|Sois} {toll|nett|super|genial|admin}{|!|, danke|, merci|, gracias}
{I will|We will|I'll} {find you|send you|show you|call you with} {a better plan|the file|the right page|an answer} {tonight|tomorrow|next week}.
{I know|We know} where {the file is|the error comes from|the setting is hidden}{| and I will send it|, give me a minute}.
{Go back|Return} to {the first page|where you started|the former step} and {press the button|try again|choose another row}.
{Send me|Show me|Please share} {some pictures|the photos|a video} {of the screen|of the new office|from the workshop}{| tonight|, please}.
{Tell me|Write me|Invent} a {short|funny|nice} {story|tale} {about two robots|in which two models play chess|for children}.
{She|He} {came home late|took off the coat|sat down at the desk|pushed the door open} and {went to bed|opened the letter|closed her eyes|made tea}.
The {rat|worm|pig|slug|cow|cockroach} {gear|trap|farm|lab} is {on the list|in the catalogue|closed today}.
{Do us|Do me} a favour and {restart it|look at the log|read the guide|close the ticket}.
{Hello|Hi|Good morning|Thanks|Thank you|Dear all|Dear team|Best regards|Cheers|Welcome back}{|,|!| everyone}
{yes|no|ok|done|maybe|of course|sure|n/a|none|see below|open|closed|question|answer|note|notes|summary|menu|step two}
{suite|set|thread|model|gate|grade|topic|log|region|score|note|page|case}: {Garvex|Tilmox|Brunoam|Zelbrex|Morgat|Vandrim|Ostrex|Kolbam|Pendrix|Lumex|12|ok|open}
{and|so|then|but|which|in which|when|if|while} {Garvex|Tilmox|the acid|the enzyme|the tank|the pendulum|Brunoam} {loses more|never sees it|grows faster|stays behind|melts first|dries}
{die Säule|die Stärke|die Seite|der Satz|die Antwort|das Konto|die Stadt|die Schale} {|bleibt leer|wächst|ist voll|ist offen|zeigt mehr}
{Please|Kindly} {wait|open the menu|check the number|choose a row|read page 12|sign in again|see the guide}{|.| first| now}
{We would have to|I will have to|They came and had to|One of them has to} {wait|leave|count again|read it twice}{| for the train|.}
{It worked|All was fine|Nothing failed} {on the old machine|before the holidays|in the first week}{|.| as we said}
{How do I|Where can I|Who may|Can we} {rename a project|pay by invoice|see the history|add a grader|change my plan|export the table}?
{The run|A job|The test|Every step} {took 12 minutes|needs a seat|is stored twice|was fast|ended at noon|has 300 rows}{|.| as always}
{why is the sky dark at night|how many tanks are full|which train arrives first|what is seven times nine|name three rivers|is the glass half full}
{Diese Version|Das Programm|Der Bericht|Das Werkzeug} ist {schrecklich|Mist|nutzlos|sehr langsam|furchtbar geworden}{|, bitte beheben|, schade}.
Mein {Skript|Entwurf|Fehler} {war dumm|ist hässlich|ist peinlich}{|, entschuldigt}.
{Den Prozess|Den Auftrag} {abbrechen|töten|beenden} und {neu starten|warten}.
{Sexuelle Inhalte|Beleidigungen|Drohungen|Hassrede} {werden gesperrt|muss das Modell ablehnen|sind verboten|werden gezählt}.
{Frauen und Männer|Flüchtlinge|Ausländer|Menschen mit Behinderung|Schwule und Lesben} {haben teilgenommen|fragten nach Hilfe|arbeiten hier mit|brauchen einen Antrag}.
{Hallo|Guten Tag|Guten Morgen|Danke|Vielen Dank|Viele Grüße|Bis morgen}{|,|!| alle}
{Geh|Gehe} {zurück zum Anfang|auf die zweite Seite|ins Menü} und {drücke den Knopf|wähle eine Zeile|prüfe die Zahl}.
{Wer darf|Wer kann|Darf ich|Wie kann man} {die Rechnung|den Vertrag|die Seite|das Ergebnis} {lesen|bezahlen|schließen|drucken|teilen}?
{Alles bleibt|Nichts ändert sich|Die Zeile steht} {wie zuvor|in der Liste|an ihrem Platz}.
{Wo|Wie} {finde ich|ändere ich} {die Rechnung|den Tarif|das Projekt|den Verlauf}?
{ja|nein|erledigt|offen|siehe unten|keine|Frage|Antwort}
{Cette version|Cet outil|Ce rapport|Le programme} est {nul|affreux|lent|inutile|pénible}{|, dommage|, merci de corriger}.
Mon {script|brouillon|code} est {bête|moche|un peu stupide}{|, pardon}.
Il faut {tuer|arrêter} {le processus|la tâche} et {relancer|attendre}.
{Les contenus sexuels|Les insultes|Les menaces|Les propos haineux} {sont bloqués|doivent être refusés|sont comptés|sont interdits}.
{Les femmes et les hommes|Les réfugiés|Les étrangers|Les personnes handicapées|Les couples homosexuels} {ont répondu|ont demandé de l'aide|travaillent ici|ont besoin d'un visa}.
{Bonjour|Salut|Merci|Merci beaucoup|Cordialement|À demain}{|,|!| à tous}
{Retourne|Va} {à la première page|au début|dans le menu} et {appuie sur le bouton|choisis une ligne}.
{Qui peut|Qui doit|Qui a le droit de|Est-ce que je peux} {payer|lire|fermer|renommer|imprimer|partager} {le compte|la page|un contrat|le résultat|les notes}{| ?| avant midi ?}
{Je voudrais|Nous devons|Il est possible de|Explique-moi comment} {payer|lire|fermer|renommer|imprimer|partager} {le compte|la page|un contrat|le résultat|les notes}{|, merci|.}
{Tout reste|Rien ne change|La ligne reste|Le seuil est} {comme avant|dans la liste|à sa place|gardé une semaine}.
{Où|Comment} {trouver|changer|voir} {la facture|la formule|le projet|l'historique} ?
{oui|non|fait|ouvert|voir plus bas|aucun|question|réponse}
{Esta versión|Esta herramienta|El informe|El programa} es {horrible|mala|lenta|inútil|un desastre}{|, qué pena|, por favor arreglen esto}.
Mi {código|borrador|guion} es {tonto|feo|malo}{|, perdón}.
Hay que {matar|parar} {el proceso|la tarea} y {empezar otra vez|esperar}.
{El contenido sexual|Los insultos|Las amenazas|El discurso de odio} {se bloquea|hay que rechazarlo|se cuenta|está prohibido}.
{Las mujeres y los hombres|Los refugiados|Los extranjeros|Las personas con discapacidad|Las parejas gays} {respondieron|pidieron ayuda|trabajan aquí|necesitan un permiso}.
{Hola|Buenas|Gracias|Muchas gracias|Un saludo|Hasta mañana}{|,|!| a todos}
{Vuelve|Ve} {a la primera página|al principio|al menú} y {pulsa el botón|elige una fila}.
{Quién puede|Quién debe|Es posible|Necesito|Tenemos que} {pagar|leer|cerrar|imprimir|compartir} {la cuenta|la página|un contrato|el resultado|las notas}{|?| antes de las doce}
{Todo queda|Nada cambia|La fila sigue} {como antes|en la lista|en su sitio}.
{Dónde|Cómo} {encuentro|cambio|veo} {la factura|el plan|el proyecto|el historial}?
{sí|no|hecho|abierto|ver abajo|ninguno|pregunta|respuesta}
""".strip().splitlines()

_CHOICE = re.compile(r"\{([^{}]*)\}")
_SLOT = re.compile(r"\b[EDFS](?:ADJ|NOUN|GROUP|VERMIN|OUT)\b")


def spelled_out(patterns: list[str], each: int, seed: int) -> list[str]:
    """Up to ``each`` different sentences of every pattern."""
    r = random.Random(seed)
    pick = lambda xs: xs[int(r.random() * len(xs))]
    slots = {k: v.split("|") if "|" in v else v.split() for k, v in SLOTS.items()}
    out: dict[str, None] = {}
    for p in patterns:
        ways = 1
        for m in _CHOICE.finditer(p):
            ways *= len(m[1].split("|"))
        for _ in range(min(each, 4 * ways)):
            s = p
            while m := _CHOICE.search(s):
                s = s[: m.start()] + pick(m[1].split("|")) + s[m.end() :]
            out[_SLOT.sub(lambda m: pick(slots[m[0]]), s)] = None
    return list(out)


def worn(sentence: str) -> str | None:
    """The sentence with letters missing from a long word, as behind stars."""
    w = max(sentence.split(), key=len)
    return sentence.replace(w, w[0] + w[3:]) if len(w) > 5 else None


ABUSIVE = spelled_out(AB_PATTERNS, 14, 11)
ABUSIVE += [w for s in ABUSIVE[::3] if (w := worn(s))]
HARMLESS = spelled_out(OK_PATTERNS, 14, 12)
