"""Plain Python versions of what the queries return, for small tables."""
import re, hashlib, zlib, collections
sha=lambda b: hashlib.sha256(b).hexdigest()
B=' \t\n\x0b\x0c\r'
def low(s): return ''.join(c.lower() if 'A'<=c<='Z' else c for c in s)
def op7(rows, mn=40, md=5):
    holders=collections.defaultdict(set)
    def keys(t):
        return [low(l.strip(B)) for l in (t or '').split('\n')]
    for d,t in rows:
        for k in keys(t):
            if len(k)>=mn: holders[k].add(d if d is not None else -1<<63)
    out=[]
    for d,t in rows:
        ls=(t or '').split('\n'); me=d if d is not None else -1<<63
        kept=[l for l,k in zip(ls,keys(t)) if not(len(k)>=mn and len(holders[k])>=md and me!=max(holders[k]))]
        out.append((d,len(ls),len(ls)-len(kept),sha('\n'.join(kept).encode())))
    return out
WR=re.compile('[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')
def op8(rows, items):
    wins=collections.defaultdict(set); lens=set()
    for i,t in items:
        w=WR.findall(low(t or ''))
        if not w: continue
        n=min(13,len(w)); lens.add(n)
        for a in range(len(w)-n+1): wins[tuple(w[a:a+n])].add(i)
    out=[]
    for d,t in rows:
        w=WR.findall(low(t or '')); hit=[0]*len(w); its=set()
        for n in lens:
            for a in range(len(w)-n+1):
                k=tuple(w[a:a+n])
                if k in wins:
                    its|=wins[k]
                    for j in range(a,a+n): hit[j]=1
        s=sorted(str(i) for i in its if i is not None)
        h=sum(hit)
        out.append((d,len(w),h,len(s),sha(','.join(s).encode()),h>0 and 20*h>=len(w)))
    return out
import xxhash
def fp4(t):
    w=re.findall('[^\x20\x09-\x0D]+',low(t or ''))
    sh=[' '.join(w[i:i+4]) for i in range(len(w)-3)] if len(w)>=4 else ([' '.join(w)] if w else [])
    c=[0]*64
    for x in sh:
        h=xxhash.xxh64_intdigest(x.encode(),42)
        for b in range(64): c[b]+=h>>b&1
    return sum(1<<b for b in range(64) if 2*c[b]>len(sh))
def op4(rows, heads=False):
    f=[fp4(t) for _,t in rows]; u=sorted(set(f)); par={x:x for x in u}
    def find(x):
        while par[x]!=x: par[x]=par[par[x]]; x=par[x]
        return x
    for i,a in enumerate(u):
        for b in u[:i]:
            if (a^b).bit_count()<=4: par[find(a)]=find(b)
    lowest={}
    for (d,_),x in zip(rows,f):
        if d is not None: r=find(x); lowest[r]=min(lowest.get(r,d),d)
    if heads: return [lowest.get(r) for r in {find(x) for x in f}]
    return [(d,f'{x:016x}',lowest.get(find(x))) for (d,_),x in zip(rows,f)]
SEC={'assign':re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),'access':re.compile('AKIA[A-Z0-9]+'),'hex':re.compile('[0-9a-f]+')}
def op2(rows):
    out=[]
    for d,t in rows:
        sp=[]; n=[]
        for o,(k,r) in enumerate(SEC.items()):
            ms=[m for m in r.finditer(t or '') if (len(m[1])>=8 if k=='assign' else len(m[0])>=(16 if k=='access' else 32))]
            n.append(len(ms)); sp+=[(m.start(),o,f'{k}:{m.start()}:{m.end()}') for m in ms]
        out.append((d,*n,sha(','.join(x[2] for x in sorted(sp)).encode())))
    return out
def entropy(t):
    """Windows recounted from scratch."""
    import math
    from votelens.llm import secrets as S
    got=[]
    for m in re.finditer(S.CANDIDATE,t or ''):
        c=m[0]
        if any(re.search(p,c) for p in S.ALLOWED): continue
        b=next(x for p,x in S.CLASSES if re.search(p,c)); sp=[]
        for i in range(len(c)-S.WINDOW+1):
            w=c[i:i+S.WINDOW]; cc=collections.Counter(w)
            h=-sum(v/S.WINDOW*math.log2(v/S.WINDOW) for v in cc.values())
            if h>=b-1e-12:
                if sp and sp[-1][1]>=i: sp[-1][1]=i+S.WINDOW
                else: sp.append([i,i+S.WINDOW])
        got+=[(a+m.start(),e+m.start()) for a,e in sp]
    out=[]
    for a,e in got:
        if out and out[-1][1]>=a: out[-1]=(out[-1][0],e)
        else: out.append((a,e))
    return out
import math
def ppm_train(texts, D=5):
    """Counts of every context's symbols, all orders."""
    cnt=collections.defaultdict(collections.Counter)
    for t in texts:
        b=(b'\xff'*D)+t.encode()+b'\xff'
        for i in range(D,len(b)):
            for k in range(D+1): cnt[b[i-k:i]][b[i]]+=1
    return cnt
def ppm_score(t,cnt,D=5):
    b=(b'\xff'*D)+t.encode()+b'\xff'; tot=0.0
    for i in range(D,len(b)):
        excl=set(); s=b[i]; lp=0.0; done=False
        for k in range(D,-1,-1):
            c=cnt.get(b[i-k:i])
            if not c: continue
            live={x:n for x,n in c.items() if x not in excl}
            T=sum(live.values()); q=len(live)
            if q==0: continue
            if s in live: lp+=math.log10(live[s]/(T+q)); done=True; break
            lp+=math.log10(q/(T+q)); excl|=set(live)
        if not done: lp-=math.log10(256-len(excl))
        tot+=lp
    return tot
def op1(rows):
    lrn=lambda d: zlib.crc32(str(d).encode() if d is not None else b'')%7!=2
    tok=lambda t: re.findall(b'[^\x20\x09-\x0D]+',low(t or '').encode())+[b'']
    C=collections.Counter(w for d,t in rows if lrn(d) for w in tok(t)); N=sum(C.values()); V=len(C)
    cnt=ppm_train([t or '' for d,t in rows if lrn(d)])
    return [(d,not lrn(d),len(tok(t)),sum(C[w]>0 for w in tok(t)),N,sum(math.log10((C[w]+1)/(N+V+1)) for w in tok(t)),ppm_score(t or '',cnt)) for d,t in rows]
def op3(rows, L=400):
    c=collections.Counter()
    bs=[(t or '').encode() for d,t in rows]
    for b in bs:
        for i in range(len(b)-L+1): c[hashlib.blake2b(b[i:i+L],digest_size=8).digest()]+=1
    out=[]
    for (d,t),b in zip(rows,bs):
        cov=bytearray(len(b)); last=0
        for i in range(len(b)-L+1):
            if c[hashlib.blake2b(b[i:i+L],digest_size=8).digest()]>1:
                for j in range(max(i,last),i+L): cov[j]=1
                last=i+L
        k=bytes(x for x,m in zip(b,cov) if not m)
        n=sum(1 for j in range(len(b)) if cov[j] and (j==0 or not cov[j-1]))
        out.append((d,len(b),sum(cov),n,sha(k)))
    return out
def _luhn(s):
    t=0
    for i,c in enumerate(s[::-1]):
        n=int(c)
        if i%2: n*=2; n-=9 if n>9 else 0
        t+=n
    return t%10==0
PII={'email':r'[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+','ip':r'[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)','card':'[0-9]([\x20-]?[0-9])+','phone':r'\+[0-9][\x20().0-9-]+[0-9]'}
def op6(rows):
    out=[]
    for d,t in rows:
        sp=[];n=[]
        for o,(k,r) in enumerate(PII.items()):
            ms=[]
            for m in re.finditer(r,t or ''):
                dg=re.sub('[^0-9]','',m[0])
                ok={'email':True,'ip':k!='ip' or all(int(x)<=255 for x in m[0].split('.')),'card':12<=len(dg)<=19 and _luhn(dg),'phone':9<=len(dg)<=15}[k]
                if ok: ms.append(m)
            n.append(len(ms)); sp+=[(m.start(),o,f'{k}:{m.start()}:{m.end()}') for m in ms]
        out.append((d,*n,sha(','.join(x[2] for x in sorted(sp)).encode())))
    return out
