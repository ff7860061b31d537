"""Small labelled table for the tagger of personal data: sentence patterns with marked slots, written for this purpose and filled by
rule from a fixed seed.

A pattern holds alternatives in parentheses, ``(a|b)``, and slots: {e} e-mail address, {p} phone number, {i} number issued to a
person with its label, {a} street or post box, {n} person's name. What stands outside these is not personal, and neither is what
the other slots stand for: {m} menu words, {f} firms, {d} models and products, {k} invented names of sets and regions, {x} numbers
and codes of orders, tickets, builds and machines, {t} dates and times, {q} amounts. Patterns without personal slots are in PLAIN."""

from __future__ import annotations

import random
import re

CARRIERS = """
(My|The|Our|Their) (e-mail|mail|email address|account|user) is {e}(.| now|, thanks)
(Please|Could you|You may) (write|answer|forward it|mail all of it|deliver the report) to {e}(.|, please|, the old one is dead)
(I|We|They) (wrote|posted this|asked|signed in) from {e}(.| yesterday)
(sign in|signed up|registered|logged on) (as|with) {e}
{e} (is locked|does not work|gets nothing|is unknown here|was removed|failed again)(.|)
(from|to|cc|bcc|email|e-mail|mail|contact|user|account): {e}
(user|mail|login|to)="{e}"
("email"|"user"|"reply"): "{e}"
(Does|Has|Did) {e} (exist|get the report|answer|reach you)?
(Add|Remove|Invite|Block) {e}(| please|, not the others|.)
{e}
(Meine|Unsere) (Adresse|Mail|E-Mail) (ist|lautet) {e}.
(Schreib|Antworte|Sende alles|Bitte alles) an {e}(.|, danke|)
(Das Konto|Der Benutzer|Mein Login) {e} (geht nicht|fehlt|wurde entfernt).
(Mon|Notre) (adresse|mail|courriel) est {e}.
(Merci d'écrire|Répondez|Envoyez tout) à {e}(.|, merci|)
Le compte {e} (ne marche plus|est fermé|a été supprimé).
(Mi|Nuestro) (correo|e-mail|usuario) es {e}.
(Escriba|Responda|Mándalo todo) a {e}(.|, gracias|)
La cuenta {e} (no funciona|está cerrada|falta).
(My|Our|The) (phone|number|mobile|cell|desk line) is {p}(.|, in the evening|)
(Please|You can|Just) (call|ring|phone|dial|text) (me|us|the office|her) (on|at|under) {p}(.| after lunch| before noon| if it burns)
{p} (is busy|rings but no one answers|is my new number|reaches the front desk|works too)(.|)
(phone|tel|mobile|cell|fax|WhatsApp|Signal)(:| |. ){p}
(phone|tel|mobile)="{p}"
("phone"|"mobile"|"fax"): "{p}"
(The message|The text|The pin) (came from|went to|was sent to) {p}(.| instead| but I never got it)
(We tried|I dialled|He called) {p} (twice|all day)(.| but nobody answered.)
(Meine|Unsere) (Telefonnummer|Handynummer|Durchwahl) (ist|lautet) {p}.
(Ruft|Bitte rufen Sie) (mich|uns) unter {p} (an|zurück).
(Telefon|Tel.|Handy|Mobil)(: | ){p}
{p} (ist besetzt|stimmt nicht mehr|geht nicht).
(Mon|Notre) (téléphone|portable) est le {p}.
(Rappelez|Contactez|Joignez)-(moi|nous) au {p}(.| ce soir.)
(Téléphone|Tél.|Portable)( : | ){p}
Le {p} (sonne dans le vide|est occupé|ne marche pas).
(Mi|Nuestro) (teléfono|móvil) es el {p}.
(Llame|Llamen|Marca|Marque) al {p}(.| por la tarde.)
(Teléfono|Móvil|Tel.)(: | ){p}
El {p} (no responde|comunica|no va).
(Here|This) is (what they asked for|my proof|the one you need): {i}(.|)
(I have to give you|They wanted|You need|Do you need|I typed) {i}(.|, I think|?)
{i}(.|, please delete it|, is that right?| if that helps)
(Please|You can) (check|verify|remove|store) {i}(.|)
(My file shows|On the form I wrote|In your data you keep) {i}(.| and it is wrong)
(Proof|Identity|ID check|Document): {i}
(Als Nachweis|Hier bitte|Zum Abgleich): {i}.
(Ihr braucht|Man wollte von mir|Im Formular steht) {i}(.|, oder)
{i}(, bitte löschen| wurde abgelehnt|, wenn es hilft).
(Comme preuve|Voici|Document) : {i}.
(On me demande|Il vous faut|Le dossier contient) {i}.
{i}(, à effacer| a été refusé|, si cela aide).
(Como prueba|Aquí está|Documento): {i}.
(Me piden|Necesitan|El formulario tiene) {i}.
{i}(, para borrar| fue rechazado|, si ayuda).
(Our|My) (home|flat|house|office|branch) is (at|in|) {a}(.|)
(Deliver|Post|Mail|Bring) (it|the box|the papers|the letter) to {a}(.| by noon|)
(The letter|A parcel|The technician) (goes|came|should go) to {a}(.| today|)
(She|He|They) (lives|live|stays|works) at {a}(.|)
(The form|Your page|The map) (refuses|doesn't know|rejects) {a}(.|)
(address|home|delivery|billing address|ship to|sender|from): {a}
(Visit|Find|Meet) us at {a}.
We (left|gave up|sold) (the flat|the shop), (now it is|write to) {a}.
(Meine|Unsere) (Anschrift|Lieferadresse|Adresse) (ist|lautet) {a}.
(Schickt|Bringt|Liefert) (den Brief|das Paket|alles) (an|in die|zu) {a}.
(Er wohnt|Wir sitzen|Das Büro liegt) (in der|am|hier:) {a}.
(Anschrift|Lieferung): {a}
(Mon|Notre) adresse (est|c'est) {a}.
(Livrez|Postez|Apportez) (le colis|la lettre|tout) au {a}.
(Il habite|Nous sommes|Le bureau est) (au|à l'adresse) {a}.
(Adresse|Livraison) : {a}
(Mi|Nuestra) (dirección|casa|oficina) (es|está en) {a}.
(Lleven|Manden|Entreguen) (el paquete|la carta|todo) a {a}.
(Vive|Estamos|La oficina está) en {a}.
(Dirección|Entrega): {a}
(This is|It's|Here is) {n}(.|, hello| speaking| from sales)
(Yours|Greetings|Kind regards|Cheers|Sincerely|Many thanks|Love)(, | |,\\n){n}
(I met|I asked|We called|Somebody saw|Tell|Contact|Remind|Ask) {n}(.| today| about it| last week|, please)
{n} (said|thinks|told me|confirmed|wrote|signed|knows|left|complains|agrees|is away|is my boss|has left us|will call you|can do it)(.| so| that it is fine| again|)
(The licence|This desk|That account|The laptop|Our seat) (is for|was given to|is owned by|is used by) {n}(.|)
(Both|Only|Even|Maybe|Either) {n} (and|or) ({n}|me|we) (know|have it|could do this|did it)(.|)
Neither {n} nor (he|she|we|{n}) (knew|came|has it|may do so)(.|)
(made|built|created|written|set|reviewed|signed|started) by {n}(| in May|, I guess|.)
(user|owner|author|name|assignee|contact|cc|bcc): {n}
(user|member|account|owner) (‘{n}’|"{n}"|'{n}') (is missing|left|has no seat)
(As|Like) {n} (said|wrote|told us|showed|put it)(, | )(it is|this was) (broken|late)(.|)
(Dear|Hi|Hello|Hey) {n}(,|, thanks for the answer.|!)
(Please|Kindly) (ask|tell|inform|let) {n}(| know|.)
{n} (checked|approved|saw|made|wants|needs|owns|has|uses|opened|closed|found|sent|reported) (it|this|that|the file|a seat)(.| already.| twice.|)
(I|We|They|She) (spoke|talked|met|agreed|worked|sat) with {n}(.| yesterday.| on the stairs.|)
(The seat|The desk|It|This) (belongs|goes|was lent) to {n}(.|)
{n} (here|again|too)(,|:|.| once more.) 
(Thank you|Thanks again|Many thanks|Best)(!|,|.) {n}
(Greetings|Regards|Yours truly)(,| from) {n}
{n} (in|of|from) (the lab|marketing|our team|finance|the office) (has|sees|reports|got) (the same|no access)(.|)
(My name's|The name is|I'm called) {n}(.|)
(Signed|Thanks|Ciao|Bye|Best wishes)(, |! | ){n}
(cc|fyi|attn) {n}
{n}
(- |)(Hier spricht|Hier schreibt|Das ist|Ich bin|Mein Name ist) {n}(.|)
(Mit besten Grüßen|Liebe Grüße|MfG|Schöne Grüße|Beste Grüße)(, | |,\\n){n}
(Ich traf|Wir fragten|Bitte informiert|Fragt|Ich rief) {n}(.|)
(Bitte|Man soll) {n} (rufen|informieren|suchen).
{n} (sagt|meint|schrieb mir|weiß es|hat das gemacht|kann helfen|ist krank)(.|)
(Das Konto|Dieser Rechner|Die Lizenz|Das Büro) (ist für|ist von|nutzt|bekam) {n}.
(Heute|Letzte Woche|Das) (sprach|hat|prüfte|traf) (ich |)(mit |){n}(.| gemacht.)
(von|mit|für|durch) {n} (erstellt|besprochen|geprüft)
{n} (prüfte|sah|machte|will|braucht|öffnete|fand|schickte|erlaubte|bestätigte) (es|das|die Datei|einen Platz)(.| schon.| zweimal.|)
(Gestern|Heute|Dann) (redete|arbeitete|sprach) ich mit {n}(.| darüber.)
(Der Stuhl|Das|Dieser Platz) (gehört|ist von) {n}(.|)
(Wieder|Nochmal) {n}(.| hier.)
(Grüße|Gruß|Danke)(,| von) {n}
{n} (vom Vertrieb|aus dem Labor|von der Technik|aus dem Einkauf) (hat das auch|hat es gemeldet).
(Sehr geehrte|Sehr geehrter|Liebe|Lieber) {n},
(- |)(C'est|Moi c'est|Ici, c'est|Mon nom est) {n}(.|)
(Bien à vous|Amicalement|Sincères salutations|À bientôt)(, | |,\\n){n}
(J'ai vu|Nous avons appelé|Prévenez|Contactez|Cherchez) {n}(.|)
(C'est|Ce n'est pas) {n} qui (a signé|l'a fait|décide)(.|)
{n} (dit|pense|m'a écrit|le sait|est absent|peut aider)(.|)
(Le compte|La licence|Ce poste|Le fauteuil) (est pour|est à|revient à|est au nom de) {n}.
(fait|signé|écrit|vu|parlé) (par|avec) {n}
{n} (a vu|a fait|veut|a ouvert|a trouvé|a envoyé|a permis) (cela|le fichier|une place)(.| déjà.|)
(Hier|Lundi|Puis) j'ai (travaillé|discuté|mangé) avec {n}(.| de cela.)
(Salutations|Merci encore|Amitiés)(,| de) {n}
{n}, (du service client|de l'atelier|du labo), (a pareil|l'a signalé).
(Chère|Cher) {n},
(- |)(Aquí|Habla|Soy yo,|Mi nombre es) {n}(.|)
(Atentamente|Saludos|Un abrazo|Hasta pronto)(, | |,\\n){n}
(Vi a|Llamamos a|Avisa a|Contacten a|Busca a) {n}(.|)
(Lo hizo|Lo firmó|Lo decidió|Lo sabe) {n}(.|)
{n} (dice|piensa|me escribió|está fuera|puede ayudar)(.|)
(La cuenta|La licencia|Este puesto|La silla) (es para|pertenece a|es de) {n}.
(hecho|firmado|visto|hablé) (por|con) {n}
{n} (vio|hizo|quiere|abrió|encontró|envió|permitió) (eso|el archivo|un puesto)(.| ya.|)
(Ayer|El lunes|Luego) (trabajé|comí|quedé) con {n}(.| por esto.)
(Recuerdos|Gracias otra vez|Abrazos)(,| de) {n}
{n}, (de ventas|del taller), (tiene lo mismo|lo avisó).
(Querida|Estimado) {n},
""".strip().splitlines()

PLAIN = """
(Click|Go to|Choose|Find|Select|Visit) {m}(, then {m}| and {m}|)(.| once.)
{m} > {m}( > {m}|)
(In|Under|Below|Inside) {m} (you see|there is|look for) {m}(.|; press {m}.|, and {m} ends it.)
(Only|Without) {m} (nothing happens|you lose it|it stays open)(.|)
The (button|tab|page|menu|entry) {m} (is grey|is missing|moved|does it)(.|)
(Look|See) {m}(,|:) the (small|green|left) button {m} (ends it|is enough)(.|)
1. {m}\\n2. {m}\\n3. {m}
(Steps|How to|This way):\\n1. {m}\\n2. {m}
(Order|Invoice|Ticket|Case|Request|Job|Build|Run|Desk|Page|Hall|Error|Port|Line|Batch|Serial|Machine) (no. |number |#|){x}(.| is open.| failed.| has the trace.)
(The|Our|My) (order|ticket|build|version|queue|serial|checksum|ratio|invoice) (is|was|says) {x}(.| from {t}.|)
(It runs|We are) on {x}(.| in our cellar.)
(trace|hash|sha|request|job|build|checksum|crc|EAN) {x}
(Scale|Rate|Ratio|Score|Mix) {x}, (checksum|sum|EAN|code|stamp) {x}(.|)
(Version|Release) {x} (is out|has it too|was fine)(.|)
(Sheet|Page|Leaf|Rule) {x} of the (book|manual|notes|norm), (Chapter|Part|Article|Section) {x}, (is wrong|differs|has it)(.|)
{x} (people|servers|Row helpers|Print jobs|Street lamps), (Row|Gate|Track|Lane|Hall) {x}, (wait|rest|are full)(.|)
(Step|Chapter|Section|Table) {x} (of the manual|of our book) (is wrong|differs)(.|)
(It took|Wait|This needs|Allow) (about |) {q}(.| more.)
(We have|They sent|The file has) {q}(.| a week.|, most of them empty.)
(The price|The bill|Our quote) (is|was) {q}(.|)
(We met|It began|Our contract ends|The release came) on {t}(.| at noon.|)
(In|Since|Until|Before) (April|May|June|July|March) (we|they|it) (pay|wait|was fine)(.|)
{f} (and|or) {f} (share a plan|use it too|are customers)(.|)
(We at|The people of|Somebody at) {f} (like it|saw the same)(.|)
The {d} model (in {k}|is slow|answers fast|of last year)(.|)
(We use|They tried|Switch to) {d}(.| now.|, it is cheaper.)
(The|Our) (set|suite|region|theme|plan|project|topic|dataset) {k} (is done|is slow|has rows|was copied)(.|)
(Do it|Run it|Copy it) for (the |){k}( set| as well|)(.|)
(The theme|Our skin) is (called|named) (Green|Castle|Mill|Old|North) (Street|Road|Lane|Avenue)(.|)
(Do|Copy|Save|Repeat|Use) (it|that|this) (for|with|in|from) ({k}|{m}|{d})( if it fails| as well| once more| instead| first|)(.|)
({k}|{m}) (does|ends|keeps|shows|wins|stores) (the rest|it|the value|nothing)(.|)
(End|Finish|Close|Leave|Confirm) (it |)with {m}(.| at last.)
(Somebody|An owner|The boss) (must|has to|can) (open|unlock|free) {m}(,| and) (open|unlock|press) {m}(.|)
(As|Since|Because) (a|the) {d} (is slow|was updated), (we|they) (wait|moved)(.|)
(Ask|Write to|Use the login of) (your admin|the owner|support|the help desk|your boss|someone)(.|)
(Ping|Tell|cc) (@here|@team|@channel|@support)(.| please)
(The note|The log|It) (shows|says|has) ([EMAIL]|[NAME]|<phone>|[REDACTED]|***)(.| only|)
(Thanks|Thank you|Hello|Hi|Good morning|Good evening|Cheers)( a lot| all| everyone| there| again|)(!|.|,|)
(Regards|Best wishes|Yours), (the team|support|your help desk)
(The phone|The e-mail|The address|The name|The card) (field|icon|column|button) is (empty|grey|short|wrong)(.|)
(Please|Kindly) (read|open|close|check|store) (the page|the list|this form|a copy)( first| before noon| again|)(.|)
(How|Where|When|Why) (do|can|should) (I|we) (see|change|share|stop|print) (the list|a graph|my plan|two rows|an old test)?
(I want to|We need to|They try to) (see|change|share|stop|print|order) (the list|a graph|our plan|two rows|an old test)(.| by Monday.| but it fails.| before we leave.)
(Somebody|Everyone|No one|Another user|The other group) (has|sees|gets|wrote) (this|nothing|it too|the same thing)(.|)
(n/a|N/A|none|-|no answer|[nothing])
(Use|Show|Read|Keep|Copy) (last|this|next) (week|month|year)'s (list|page|answer|notes|draft)(.|, please.| again)
(Sorry|Pardon|Excuse us) (for the delay|for asking again)(!|.|,)
(Perdón|Disculpa|Siento) (el retraso|la demora)(!|.)
(Désolé|Pardon) (du retard|pour le délai)( !|.)
(Yes|No|Maybe|Sure|Not now|See above|Try later|Fine here|Unclear)(.|,| thanks|)
(It is|That was|This is) (possible|fine|not included|too slow|urgent|a bug)(.| at times.| for us.)
(You are|Act as|I am) (a|the) (helper|assistant|bot) (of|for) (a product|a shop|our tool)(.| Be short.)
(As a|Being a) (bot|helper), I (can't answer|don't know) that(.|)
(The export|The table|A row) (keeps|loses|holds) (its state|the value|an old limit)( each time| for now|)(.|)
{"limit": {x}, "scope": "all"}
$ (run|tool|job) export --set {k} --limit {x}
retry(limit={x}, wait={x})
(Klick|Geh|Öffne|Wähle|Suche) (auf |in |){m}(, dann {m}|)(.| und {m}.)
(Unter|In|Neben) {m} (steht|findest du|liegt) {m}(.|, danach {m}.)
(Die Seite|Das Formular|Der Knopf|Der Tarif|Ein Lauf|Die Menge|Das Protokoll) (ist grau|bleibt leer|wirkt sofort|kostet {q}|zeigt Fehler {x})(.|)
(Die Bestellung|Das Ticket|Der Auftrag|Die Version|Der Stand) {x} (fehlt|ist vom {t}|zeigt es)(.|)
(Seite|Regel|Kapitel) {x} (im Buch|der Norm|der Notizen) (ist falsch|erklärt es|irrt)(.|)
(Wir nutzen|Das Modell|Nehmt) {d}(.| ist langsam.)
(Es geht um|Nimm|Kopiere) (den Satz |){k}(.|)
(Mit|Für|Durch|Ohne|Unter|Nach|Bei) ({m}|{k}) (geht es|endet es|wird gespeichert|bleibt alles)(.|)
(Macht|Beendet|Speichert|Wiederholt) (es|das) (mit|für|in) ({m}|{k})(.|, wenn es geht.| und {m}.)
(Die|Eine|Keine|Meine) (Rechnung|Zeile|Tabelle|Prüfung|Auswertung|Frage|Antwort|Gruppe|Woche|Stunde) (mit|für|ohne|nach) (Bildern|Fehlern|Zahlen|Gästen|Kunden|Namen|Rechten|Seite)(.| fehlt.| ist da.|)
(Wort|Seite|Stück|Zeile|Tag) für (Wort|Seite|Stück|Zeile|Tag)(.|, bitte.)
(Der|Ein|Kein|Mein) (Satz|Knopf|Auftrag|Schlüssel|Bericht|Rechner|Versuch|Vorgang|Kunde|Gast) (aus|bei|vom|zum) (Lager|Start|Test|Server|Archiv|Verkauf|Herbst)(.| fehlt.| lief gut.|)
(Bis|Seit|Ab) (Montag|Dienstag|Freitag|Januar|Ende Mai) (soll|muss|kann) (die Liste|der Bericht|alles) (fertig sein|warten|laufen)(.|)
(Das|Dieses|Jedes) (Ergebnis|Konto|Formular|Fenster|Feld|Gerät|Werkzeug) (steht|liegt|erscheint|wartet) (im|am|beim|unter) (Menü|Rand|Archiv|Anfang|Ende)(.|)
(Das Fenster|Es|Der Server|Man) (zeigt|meldet|sieht) (nur |) (Fehler|Code|Zeile|Regel|Stufe) {x}(.|, sonst nichts.)
(La pantalla|El servidor) (solo |)(muestra|da) (el error|el código|la línea) {x}(.|)
(L'écran|Le serveur) (affiche|donne) (seulement |)(l'erreur|le code|la ligne) {x}(.|)
(The screen|The server|It) (only |)(shows|gives) (error|code|line|rule) {x}(.|)
| (row|part|name) | (where|value) |\n|---|---|\n| {x} | {k} |
(Wie|Wo|Wann) (kann|soll) (ich|man) (das sehen|die Liste ändern|den Tarif wechseln|Zeilen drucken)?
(Ich muss|Wir wollen|Ihr sollt) (das prüfen|die Liste ändern|einen Platz bestellen|Zeilen drucken)(.| bis Montag.)
(Danke|Hallo|Guten Morgen|Vielen Dank|Guten Abend)( sehr| zusammen| an alle|)(!|,|.|)
(Ja|Nein|Vielleicht|Fragt den Admin|Siehe oben)(.|, danke|)
(Cliquez|Allez|Choisis|Cherche) (sur |dans |){m}(, puis {m}|)(.| et {m}.)
(Sous|Dans) {m} (il y a|se trouve|tu vois) {m}(.| ; ensuite {m}.)
(La page|Le formulaire|Le bouton|La formule|Un test|Le lot|Le journal) (est gris|reste vide|change vite|coûte {q}|donne l'erreur {x})(.|)
(La commande|Le ticket|La tâche|La version|Le numéro) {x} (manque|date du {t}|le montre)(.|)
(La page|La règle|Le chapitre) {x} (du livre|de la norme|des notes) (est faux|se trompe|l'explique)(.|)
(Les|De) (gros|petits|vieux) (lots|fichiers|comptes) de (plus|moins) de {x} (lignes|pages) (attendent|partent)(.|)
(Nous utilisons|Le modèle|Prenez) {d}(.| est lent.)
(C'est pour|Prends|Copie) (le jeu |){k}(.|)
(Avec|Pour|Sans|Dans|Après) ({m}|{k}) (tout finit|on enregistre|rien ne change)(.|)
(Finis|Garde|Répète) (tout|cela) (avec|pour|dans) ({m}|{k})(.| et {m}.|)
({m}|{k}) (fait la suite|garde tout|ne change rien)(.|)
(La|Une|Chaque) (ligne|image|clé|semaine|liste|question) (avec|sans|de|pour) (images|erreurs|chiffres|clients|photos)(.| manque.|)
(Comment|Où|Quand) (puis-je|peut-on|dois-je) (voir cela|changer la liste|imprimer deux lignes) ?
(Je dois|Nous voulons|Il faut) (vérifier|changer la liste|commander une place|imprimer)(.| avant lundi.)
(Merci|Bonjour|Bonsoir|Salut)( beaucoup| à tous| encore|)(!|,|.| !|)
(Oui|Non|Peut-être|Voyez avec l'admin|Voir plus haut)(.|, merci|)
(Pulsa|Ve|Elige|Busca) (en |a |){m}(, luego {m}|)(.| y {m}.)
(Debajo de|En) {m} (hay|está|verás) {m}(.|, después {m}.)
(La página|El formulario|El botón|El plan|Una prueba|El lote|El registro) (está gris|queda vacío|cambia ya|cuesta {q}|da el error {x})(.|)
(El pedido|El ticket|La tarea|La versión|El número) {x} (falta|es del {t}|lo muestra)(.|)
(La página|La regla|El capítulo) {x} (del libro|de la norma|de las notas) (se equivoca|lo explica|falla)(.|)
(Usamos|El modelo|Toma) {d}(.| va lento.)
(Es para|Toma|Copia) (el conjunto |){k}(.|)
(Con|Para|Sin|En|Tras) ({m}|{k}) (termina|se guarda|sigue igual|va mejor)(.|)
(Acaba|Sigue|Guarda|Repite) (todo|eso|esto) (con|para|en) ({m}|{k})(.| y {m}.|)
({m}|{k}) (hace lo demás|lo guarda|no cambia nada)(.|)
(La|Una|Cada) (fila|prueba|imagen|cuenta|llave|semana|lista) (con|sin|de|para) (imágenes|errores|números|clientes|fotos)(.| falta.|)
¿(Cómo|Dónde|Cuándo) (puedo|se puede|debo) (ver eso|cambiar la lista|imprimir dos filas)?
(Tengo que|Queremos|Hay que) (revisar|cambiar la lista|pedir un puesto|imprimir)(.| antes del lunes.)
(Gracias|Hola|Buenos días|Buenas)( a todos| de nuevo|)(!|,|.|)
(Sí|No|Quizá|Pregunta al admin|Ver arriba)(.|, gracias|)
""".strip().splitlines()

#: Given names, common ones of many places (fixed values).
FIRST = (
    "Anna Peter Maria John Emma Paul Olga Hugo Karim Julia Thomas David Laura Michael Sarah Daniel Lukas Felix Marie Pierre Claire Luc Camille Antoine Isabel Pablo Javier Elena Andrés Wei Hiroshi Akira Fatima Omar Ahmed Nadia Ivan Piotr Giulia Marco Sven Björn Ingrid Erik Aisha Kofi Ngozi Arjun Deepa Sanjay Grace Oliver Jack Amy Chloé Ethan Mia Leo Nina Greta Till Ute Jens Heike Dieter Renate Gérard Sylvie Étienne Agnès Rosa Jorge Raúl Begoña Joaquín Rolf Birgit Samuel Ruth Viktor Alma Søren Ágnes "
    "James Robert William Linda Susan Karen Lisa Mark George Helen Alice Frank Henry Lucy Simon Adam Eva Martin Klaus Hans Jürgen Stefan Andreas Monika Sabine Petra Katrin Anke Lars Nils Henrik Mats Astrid Freya Sofia Sofie Luis Carlos Miguel Diego Carmen Lucía Marta Pilar Álvaro Inés Ines Sergio Matteo Luca Chiara Paolo Francesca François Jacques Michel Nicolas Julien Hélène Zoé Zoë Léa Manon Louis Jean Anouk Yves Tomasz Pavel Marek Zofia Agnieszka Katarzyna Dmitri Yuri Mei Li Yuki Kenji Hana Min Priya Ravi Anil Leila Noor Tariq Yusuf Hassan Idris Amina Kwame Thabo Zanele Chidi Maeve Niamh Sean Liam Jonas Oskar Svenja Hannelore Amelie Elodie Bastien"
).split()
#: Family names; others are made of the parts below.
FAMILY = "Smith Jones Brown Taylor Wilson Müller Schmidt Weber Fischer Wagner Dubois Moreau Laurent García López Sánchez Kowalski Nowak Rossi Nguyen Kim Tanaka Singh Okafor Haddad O'Neill MacLeod".split()
HEADS = "Bal Cor Dun Els Fal Gran Hel Jor Kar Lan Mel Nor Pel Ros Sten Tor Ul Var Win Zel Abr Brom Cald Drum Ever Hag Yor Quil".split()
TAILS = "ton berg ford witz lund dorf rini elli ová czyk mann feld quist gård ault emard ejo illa ando aga ura oto adze yan escu ic ley by".split()
TITLES = ["Dr.", "Prof.", "Mr", "Ms", "Mrs", "Mr.", "Herr", "Frau", "M.", "Mme", "Sr.", "Sra.", "Dr"]
DOMAINS = "gmail.com outlook.com web.de orange.fr yahoo.es mail.co.uk example.com example.org posteo.net".split()
TLDS = "com org net de fr es test example invalid co.uk io".split()
MENU = "Account Profile Tools Files Export Import Team Users Reports View Help Security Plans Options Dashboard Save Next Done Submit Cancel Preferences Groups Archive Filters Konto Profil Werkzeuge Berichte Hilfe Speichern Fertig Gruppen Compte Outils Rapports Aide Enregistrer Suivant Groupes Cuenta Perfil Herramientas Informes Ayuda Guardar Siguiente Grupos|Change plan|Log out|the top row|the wheel|das Rad|la roue|la rueda".replace(" ", "|", 46).split("|")
DIGITS = "zero one two three four five six seven eight nine".split()


class Filler:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def pick(self, xs):
        return xs[int(self.r.random() * len(xs))]

    def digits(self, n: int) -> str:
        return "".join(self.pick("0123456789") for _ in range(n))

    def number(self, lo: int, hi: int) -> str:
        return self.digits(lo + int(self.r.random() * (hi - lo + 1)))

    def made(self) -> str:
        return self.pick(HEADS) + self.pick(TAILS)

    def surname(self) -> str:
        return self.pick(FAMILY) if self.r.random() < 0.25 else self.made()

    def case(self, s: str, lower: float = 0.13, upper: float = 0.08) -> str:
        x = self.r.random()
        return s.lower() if x < lower else s.upper() if x < lower + upper else s

    def n(self) -> str:
        f, s = self.pick(FIRST), self.surname()
        form = self.pick([f"{f} {s}"] * 5 + [f"{f}"] * 5 + [f"{f} {s[0]}."] * 2 + [f"{f[0]}. {s}"] * 2 + [f"{s}, {f}"] * 2 + [f"{self.pick(TITLES)} {s}"] * 3 + [f"{f} {s[0]}. {self.made()}"])
        return self.case(form, 0.2)

    def e(self) -> str:
        f, s, co = ("".join(c for c in x.lower() if c.isascii() and c.isalpha()) for x in (self.pick(FIRST), self.surname(), self.made()))
        d = self.digits
        local = self.pick([f"{f}.{s}", f"{f}_{s}", f"{f[0]}{s}", f"{s}{d(2)}", f"{f}-{d(3)}", f"{f}.{s}+{self.pick(['news', 'shop', 'work', 'x'])}", f"{f}", f"{f}_{s}+{d(1)}", f"{s}.{f[0]}", "info", f"{f}{d(4)}"])
        dom = self.pick(DOMAINS) if self.r.random() < 0.25 else self.pick(["", "", "mail.", "box.", "corp.", "x-", "uni-", "firma-"]) + co + self.pick(["", "", "." + self.pick(["works", "mail", "net"])]) + "." + self.pick(TLDS)
        at = self.pick(["@"] * 9 + [" at ", " AT ", "(at)", " [at] ", " @ ", "&#64;", "%40", "＠"])
        if at in (" at ", " AT ", " [at] ") and self.r.random() < 0.7:
            dom = dom.replace(".", " [dot] " if at == " [at] " else " dot ")
        m, x = local + at + dom, self.r.random()
        return f"<{m}>" if x < 0.06 else "mailto:" + m if x < 0.1 else m.upper() if x < 0.17 else m

    def p(self) -> str:
        d = self.digits
        if self.r.random() < 0.06:
            return " ".join(self.pick(DIGITS) for _ in range(7 + int(self.r.random() * 4)))
        base = self.pick([
            f"+1 {d(3)} {d(3)} {d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(4)}", f"{d(3)}-{d(4)}", f"{d(3)}-{d(4)}", f"+1{d(10)}", f"1.{d(3)}.{d(3)}.{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"{d(3)}-{d(3)}-{d(4)}",
            f"+44 (0){d(2)} {d(4)} {d(4)}", f"0{d(2)} {d(4)} {d(4)}", f"07{d(3)} {d(6)}", f"0{d(4)} {d(6)}", f"+44 {d(2)} {d(4)} {d(4)}", f"+44{d(10)}",
            f"0049 {d(3)} {d(7)}", f"+49 (0){d(2)} {d(5)}", f"0{d(2)} {d(5)} {d(3)}", f"(0{d(2)}) {d(5)}-{d(3)}", f"0{d(2)}/{d(7)}", f"0{d(3)}/{d(7)}", f"+49 {d(3)} {d(7)}", f"0{d(3)}-{d(6)}",
            f"0033 {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(1)}.{d(2)}.{d(2)}.{d(2)}.{d(2)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"+33 {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(9)}",
            f"(+34) {d(9)}", f"9{d(1)} {d(3)} {d(2)} {d(2)}", f"6{d(2)} {d(3)} {d(3)}", f"+34 {d(3)} {d(3)} {d(3)}", f"+34 {d(2)} {d(3)} {d(4)}",
        ])
        x = self.r.random()
        return base + (f"-{d(2)}" if x < 0.05 else f" ext. {d(2)}" if x < 0.1 else f" x{d(3)}" if x < 0.12 else "")

    def i(self) -> str:
        d, up = self.digits, self.pick("ABCDEGHKLMPRSTWXYZ")
        card = self.pick([d(16), f"{d(4)} {d(4)} {d(4)} {d(4)}", f"{d(4)}-{d(4)}-{d(4)}-{d(4)}", f"{d(4)} {d(6)} {d(5)}"])
        tail = self.pick(["", "", "K", f"<{d(1)}"])
        ssn = self.pick([f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}", d(9)])
        lic, nat, pas = f"{up}{d(3)}-{d(4)}-{d(4)}", f"{d(2)}-{d(3)}-{d(4)}", f"{up}{d(7)}{tail}"
        pre = self.pick(["", "", "my "])
        return self.case(self.pick([
            f"{pre}passport {pas}", f"passport number: {pas}", f"passport no. {pas}", f"{pre}driver's licence {lic}", f"{pre}driving licence {lic}", f"my licence is {lic}", f"licence no. {lic}", f"license {lic}", f"{pre}SSN {ssn}", f"my SSN is {ssn}", f"social security no. {ssn}", f"social security number {ssn}", f"{pre}tax ID {ssn}", f"tax number {d(10)}",
            f"{pre}NI number {up}{up} {d(2)} {d(2)} {d(2)} {up}", f"national insurance {up}{up} {d(2)} {d(2)} {d(2)} {up}", f"national id={nat}", f"ID card {nat}", f"identity card no. {nat}", f"{pre}card {card}", f"card number {card}", f"credit card {card}", f"debit card: {card}",
            f"Karte {card}", f"Kreditkarte {card}", f"meine Ausweisnummer ist {pas}", f"Personalausweis {pas}", f"Ausweis Nr. {pas}", f"Reisepass {pas}", f"Steuer-ID {d(2)} {d(3)} {d(3)} {d(3)}", f"Steuernummer {d(11)}", f"Sozialversicherungsnummer {d(2)} {d(6)} {up} {d(3)}", f"Führerschein Nr. {up}{d(9)}", f"Führerschein {lic}",
            f"carte {card}", f"carte bancaire {card}", f"passeport {pas}", f"carte d'identité n° {nat}", f"numéro fiscal {d(2)} {d(2)} {d(3)} {d(3)} {d(3)}", f"mon numéro de sécurité sociale : {d(1)} {d(2)} {d(2)} {d(2)} {d(3)} {d(3)} {d(2)}", f"permis de conduire n° {d(12)}", f"permis de conduire {lic}",
            f"tarjeta {card}", f"tarjeta de crédito {card}", f"pasaporte {pas}", f"DNI: {d(2)}.{d(3)}.{d(3)}-{up}", f"DNI {d(8)}{up}", f"DNI: {d(8)}{up}", f"NIE {up}{d(7)}{up}", f"número de la seguridad social {d(2)}/{d(8)}/{d(2)}", f"carné de conducir {d(8)}-{up}", f"permiso de conducir {d(8)}{up}",
        ]), 0.03, 0.03)

    def a(self) -> str:
        d = self.digits
        no, town, zip5 = str(1 + int(self.r.random() * 240)), self.pick(["", "", "", "Saint-", "New ", "Bad "]) + self.made(), d(5)
        town = town + self.pick(["", "", "", " am See", "-sur-Mer", " del Río"])
        name = self.pick(["Apple", "King", "Queen", "Maple", "River", "Station", "Hill", "Park", "High", "Chapel", "New Bridge", "Old Market", "Victoria", "Elm", self.made()])
        kind = self.pick(["Street", "Lane", "Close", "Row", "Ave.", "Boulevard", "Road", "Avenue", "St", "Drive", "Court", "Square"])
        de = self.pick(["Haupt", "Bahnhof", "Garten", "Wald", "Kirch", "Rosen", "Berg", self.made()]) + self.pick(["weg", "straße", "str.", "platz", "gasse", "allee", "strasse", "pl."])
        de = self.pick([de, de, de, "Am Bach", "An der Brücke", "Zum Hof"])
        fr = self.pick(["rue", "avenue", "chemin", "impasse", "quai", "boulevard", "place", "allée"]) + self.pick([" de la Gare", " du Port", " des Lilas", " Victor Hugo", " de l'Église", " des Écoles", " du Grand Pré"])
        es = self.pick(["Calle", "C/", "Plaza", "Avda.", "Camino", "Paseo", "Ronda", "Avenida"]) + self.pick([" Mayor", " del Sol", " de la Luna", " de los Reyes", " Nueva", " del Puerto", " de la Iglesia"])
        f = self.pick([
            f"{no} {name} {kind}, {town}", f"{no} {name} {kind}", f"{no} {name} {kind}\nUnit {d(2)}, {town}", f"Flat {d(1)}, {no} {name} {kind}, {town} {self.pick('ABEGLNSW')}{self.pick('ABEGLNSW')}{d(1)} {d(1)}{self.pick('ABDEH')}{self.pick('ABDEH')}", f"{no} {name} {kind}\nUnit {d(2)}\n{town}", f"PO Box {d(4)}, {town}", f"P.O. Box {d(3)}, {town}", f"{no} {self.pick('nesw')} {d(2)}th st apt {d(1)}{self.pick('abc')}, {town.lower()}", f"{no} {name} {kind}, Apt {d(2)}, {town} {zip5}",
            f"{de} {no}, {zip5} {town}", f"{de} {no} {self.pick('abc')}, {zip5} {town}", f"{de} {no}, {town}", f"{de} {no}", f"Postfach {d(2)} {d(2)}, {town}", f"Postfach {d(4)}, {zip5} {town}",
            f"{no}, {fr}, {zip5} {town}", f"{no} bis, {fr}, {zip5} {town}", f"{no} ter, {fr}, {zip5} {town}", f"{no} {fr}, bât. {self.pick('ABC')}, {town}", f"{no} {fr}, bât. {self.pick('ABC')}, {zip5} {town}", f"{no}, {fr}, {town}", f"BP {d(3)}, {town}",
            f"{es} {no}, {d(1)}º {self.pick('ABC')}, {zip5} {town}", f"{es}, {no}, {town}", f"{es} {no}, {d(1)}º A, {town}", f"{es} {no}, {zip5} {town}", f"Apartado {d(4)}, {town}", f"Apdo. de Correos {d(3)}, {town}", f"Apartado de Correos {d(3)}, {zip5} {town}",
        ])
        return self.case(f, 0.04, 0.07)

    # ---- what is not personal
    def m(self) -> str:
        return self.pick(MENU)

    def f(self) -> str:
        return self.made() + self.pick([" GmbH", " Ltd", " Inc.", " AG", " SA", " Corp", " S.L.", " & Co", " Labs", " Bank"])

    def d(self) -> str:
        return self.pick(["orca", "maple", "delta", "zephyr", "comet", "basalt", "tulip", "raven"]) + "-" + self.pick(["xl", "mini", "2", "9", "70b", "8b", "chat", "base", "large", "s", "m", "k", "30b", "nano", "pro", "test"])

    def k(self) -> str:
        name = "".join(self.pick(["tra", "vo", "pli", "sen", "dru", "kai", "mo", "bex", "tol", "wu", "fei", "zar", "nim"]) for _ in range(2 + int(self.r.random() * 2)))
        return (name + self.pick(["", "x", "th", "s", "nd", "m"])).capitalize()

    def x(self) -> str:
        d, n = self.digits, self.number
        return self.pick([n(1, 4), n(1, 4), n(5, 13), f"{n(1, 2)}.{n(1, 2)}.{n(1, 2)}", f"{n(1, 2)}.{n(1, 2)}.{n(1, 2)}", f"20{d(2)}.{n(1, 2)}.{n(2, 3)}", f"20{d(2)}-{d(2)}-{d(2)}-{n(2, 3)}", f"{d(2)}-{d(3)}-{d(4)}", f"10.{n(1, 3)}.{n(1, 3)}.{n(1, 2)}", f"{n(1, 2)}:{n(2, 3)}:{n(1, 2)}", f"{d(1)}{self.pick('abcdef')}{d(1)}{self.pick('abcdef')}-{d(3)}-{self.pick('abcdef')}{d(1)}{self.pick('abcdef')}{d(1)}", f"{self.pick('ABKQRT')}{n(2, 4)}", f"{n(3, 4)}-{n(2, 3)}", f"48{d(8)}", f"{d(2)}-{d(3)}-3344", f"{n(3, 5)}, lane {n(2, 3)},"])

    def t(self) -> str:
        month = self.pick("March April May June July September October November März Mai Juni Oktober mars avril juin octobre marzo abril mayo junio".split())
        n = str(1 + int(self.r.random() * 28))
        return self.pick([f"{n} {month}", f"{month} {n}", "Monday", "Friday", f"{n.zfill(2)}/03/2026", f"12.{n.zfill(2)}.2026", f"2026-04-{n.zfill(2)}", f"{n} {month} 2026"])

    def q(self) -> str:
        n = self.number
        return self.pick([f"{n(1, 3)} seconds", f"{n(1, 3)} rows", f"{n(1, 2)}.{n(1, 1)} cents", f"${n(1, 1)},{n(3, 3)}.00 for {n(2, 3)} seats", f"{n(3, 3)},{n(3, 3)} rows", f"{n(1, 3)} days", f"{n(1, 3)} runs", f"{n(1, 3)} Sekunden", f"{n(1, 3)} Zeilen", f"{n(1, 3)} lignes", f"{n(1, 3)} filas", f"{n(1, 3)} tokens", f"{n(1, 2)} %", f"€{n(2, 4)}"])


KINDS = {"e": "email", "p": "phone", "i": "id_number", "a": "address", "n": "name"}
_CHOICE = re.compile(r"\(([^()]*\|[^()]*)\)")
_SLOT = re.compile(r"\{([epianmfdkxtq])\}")


def labelled(rounds: int = 12, seed: int = 7) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """(text, [(start, end, kind)]): every pattern ``rounds`` times with other fillings, most of them between others as in real texts."""
    fill = Filler(seed)

    def one(pattern: str) -> list[tuple[str, str | None]]:
        s = pattern.replace("\\n", "\n")
        while m := _CHOICE.search(s):
            s = s[: m.start()] + fill.pick(m[1].split("|")) + s[m.end() :]
        out, at = [], 0
        for m in _SLOT.finditer(s):
            out += [(s[at : m.start()], None), (getattr(fill, m[1])(), KINDS.get(m[1]))]
            at = m.end()
        return [*out, (s[at:], None)]

    out = []
    sources = CARRIERS * rounds + [c for c in CARRIERS if "{n}" in c] * (rounds // 2) + PLAIN * (rounds * 3 // 2)
    for c in sources:
        parts = one(c)
        x = fill.r.random()
        if x < 0.45:
            parts = one(fill.pick(PLAIN)) + [(fill.pick([" ", " ", " ", "\n", " - ", ".. "]), None)] + parts
        elif x < 0.6:
            parts = one(fill.pick(CARRIERS)) + [(fill.pick([" ", " ", "\n", " - ", ". "]), None)] + parts
        elif x < 0.65:
            parts = [("- ", None)] + parts
        x = fill.r.random()
        if x < 0.4:
            parts += [(fill.pick([" ", " ", " ", "\n", " - ", ". "]), None)] + one(fill.pick(PLAIN))
        elif x < 0.5:
            parts += [(fill.pick([" ", " ", "\n", " - "]), None)] + one(fill.pick(CARRIERS))
        spans, at = [], 0
        for text, kind in parts:
            if kind:
                spans.append((at, at + len(text), kind))
            at += len(text)
        text = "".join(t for t, _ in parts)
        x = fill.r.random()
        text = text.lower() if x < 0.05 else text.upper() if x < 0.08 and len(text.upper()) == len(text) else text
        out.append((text, spans))
    return out
