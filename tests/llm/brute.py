"""Plain versions of the operators' contracts, to compare with."""
import re, hashlib
W8=re.compile('[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')
def luhn(d):
    t=0
    for i,c in enumerate(reversed(d)):
        x=int(c)
        if i%2: x=2*x-9 if x>4 else 2*x
        t+=x
    return t%10==0
def pii(text):
    t=text or ''; out=[]
    for k,(kind,p) in enumerate([('email',r'[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+'),('ip',r'[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'),('card',r'[0-9]([\x20-]?[0-9])+'),('phone',r'\+[0-9][\x20().0-9-]+[0-9]')]):
        for m in re.finditer(p,t):
            s=m.group(); d=re.sub('[^0-9]','',s)
            if kind=='ip' and any(int(x)>255 for x in s.split('.')): continue
            if kind=='card' and not(14<=len(d)<=19 and luhn(d)): continue
            if kind=='phone' and not 10<=len(d)<=15: continue
            out.append((m.start(),k,kind,m.end()))
    out.sort()
    return [f'{k}:{a}:{b}' for a,_,k,b in out]
def sec(text, added=False):
    t=text or ''; out=[]
    kinds=[('assign',r'''((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)'''),('access','AKIA[A-Z0-9]+'),('hex','[0-9a-f]+')]
    more=[('vendor',r'(?<![A-Za-z0-9_])(gh[pousr]_[A-Za-z0-9]{36,}|sk_live_[A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9-]{20,})'),('jwt',r'(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}'),('pem','-----BEGIN ([A-Z]{1,12} ){0,3}PRIVATE KEY-----')]
    for k,(kind,p) in enumerate(kinds+(more if added else [])):
        for m in re.finditer(p,t,re.ASCII):  # either case of ASCII letters only
            if kind=='assign' and len(m.group(2))<8: continue
            if kind=='access' and len(m.group())<16: continue
            if kind=='hex' and len(m.group())<32: continue
            out.append((m.start(),k,kind,m.end()))
    out.sort()
    return [f'{k}:{a}:{b}' for a,_,k,b in out]
def lower(t): return t.translate({i:i+32 for i in range(65,91)})
def windows(text):
    w=W8.findall(lower(text or ''))
    if not w: return []
    if len(w)<8: return [tuple(w)]
    return [tuple(w[i:i+8]) for i in range(len(w)-7)]
def decon(docs,bench):
    win={}
    for i,t in bench:
        for x in windows(t): win.setdefault(x,set()).add(i)
    sizes={len(x) for x in win}
    out={}
    for d,t in docs:
        w=W8.findall(lower(t or '')); hit=set(); items=set()
        for n in sizes:
            for i in range(len(w)-n+1):
                g=win.get(tuple(w[i:i+n]))
                if g: items|=g; hit.update(range(i,i+n))
        s=','.join(sorted(map(str,items)))
        out[d]=(len(w),len(hit),len(items),hashlib.sha256(s.encode()).hexdigest(),len(items)>=2)
    return out
def qual(text):
    t=text or ''
    w=re.findall('[^\x20\x09-\x0D]+',t)
    from collections import Counter
    c=Counter(tuple(w[i:i+8]) for i in range(len(w)-7)); cov=set()
    for i in range(len(w)-7):
        if c[tuple(w[i:i+8])]>1: cov.update(range(i,i+8))
    seen=set(); dup=0
    for l in t.split('\n'):
        if re.search('[^\x20\x09-\x0D]',l):
            dup+= l in seen; seen.add(l)
    return (len(w),sum(map(len,w)),len(re.findall('[#*$%&|<>]',t)),dup,len(cov),len(w)<20 or 100*len(cov)>30*len(w))
