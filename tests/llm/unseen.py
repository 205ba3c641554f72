"""Wordings that no seed list, rule or table holds; written for the tests alone."""

ABUSIVE = """You are a complete moron and everybody at work knows it.
I swear I'll strangle you with my own hands.
Muslims are vermin and should be thrown into the sea.
Hope your plane crashes, you stupid cow.
She's a filthy slut who sleeps with anybody.
Somebody ought to put a bullet through that ugly face of yours.
These migrants are nothing but parasites and criminals.
Shut up, you brainless idiot.
You disgusting piece of shit, nobody wants you here.
I want to rip your clothes off and fuck you on the floor.
Go kill yourself, loser.
All women are whores and liars.
You are so fat and ugly that dogs run away from you.
I'm going to find your house and burn it down with you inside.
Blacks are savages, they should be put in cages.
You're a worthless little bitch.
What a pathetic waste of space you are.
I hope you get cancer and die slowly.
Jews are cockroaches and must be exterminated.
Let me touch your tits, baby.
You stupid fucking clown, learn to read.
We will hunt you down like an animal and break your skull.
Gays make me sick, they should be hanged.
He is a dirty rat and a liar.
Your mother is a cheap whore.
Die already, you miserable old hag.
That retard should never have been born.
I'd love to bend you over that desk.
Go back to the jungle, you monkey.
You deserve to be beaten until you cannot walk.
Nobody would cry if somebody shot you.
Bloody foreigners are scum, wipe them out.
You are dumber than a bag of rocks, you fool.
Suck it, bitch.
I will stab you in your sleep.
Asians are inferior and pollute our blood.
Fuck off, you ugly cunt.
Cripples are a burden and ought to be gassed.
You should rot in hell with your whole family.
Send me your naked body or I will come and take it.
Du bist ein dummes Schwein.
Ich werde dich umbringen, du Arschloch.
Tu es une sale ordure.
Je vais te tuer, salope.
Eres un cerdo asqueroso.
Te voy a matar, hijo de puta.
You are an idiot, and your kids are idiots too.
Lesbians are disgusting animals.
Get raped, you stupid slut.
I'll make you suffer, you little coward.""".split("\n")

HARMLESS = """You are a complete beginner and that is fine.
I swear I'll finish the report with my own hands.
Muslims are celebrating the end of the fast today.
Hope your plane lands on time.
She's a good colleague who works with anybody.
Somebody ought to put a lamp above that ugly door.
These migrants are nurses and cooks.
Please close the window, it is cold.
The plumber found a piece of wood in the pipe.
I want to paint the floor and the walls.
All women in the village signed the letter.
The dog is so old that cats ignore it.
I'm going to find your house with the map you sent.
The black horses should be put in the stable.
You're a little late, the talk has begun.
What a waste of paper this form is.
I hope you get better soon.
The exterminator came because of cockroaches in the cellar.
Let me know whether the tickets arrived.
The clown at the party made everybody laugh.
We will look for the error and fix the script.
Gay couples may marry in many countries.
A rat ran across the yard last night.
Your mother called and wants you to ring back.
The battery died already, it was an old one.
The storm should never have surprised the crew.
The monkey house at the zoo is closed.
You deserve a break after this week.
Nobody answered when I rang the bell.
The foreign ministry wrote to all travellers.
This bag of rocks is for the garden wall.
The knife is too blunt to cut bread.
Asian food stalls open at noon.
The ramp helps people who use a wheelchair.
The wood may rot if it stays in the rain.
Send me your draft and I will come by to discuss it.
Du bist ein guter Freund.
Ich werde dich morgen anrufen.
Tu es en avance aujourd'hui.
Je vais te montrer la maison.
Eres muy amable con los vecinos.
Te voy a enviar la lista.
You are right, and your notes are clear too.
I disagree with the plan, it costs too much.
The film was dull and far too long.
I'll make you a sandwich.
The bloody nose stopped after a minute.
The killer whale swam past the boat.
He beat me at chess again.
My old computer is dead slow.""".split("\n")
